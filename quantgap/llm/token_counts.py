"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a batch form a trie.  Its nodes are visited depth first, which is the sorted order of the
pre-tokens; the best unigram score and the number of pieces that reach each prefix stay on a stack, so they are computed
once per shared prefix whatever number of pre-tokens continue it.  The count at a pre-token's last node is stored and
looked up for every occurrence.  Scores follow from the pieces' ranks in a public vocabulary by Zipf's law.

Every row is counted in its own task; the table of counts is a cache of bounded size, emptied when full.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgap.llm.common import ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEAD = "\u2581"  # fixed value: stands for the blank before a word
PRE_TOKEN = re.compile(f"{LEAD}?[^\\W\\d_]+|{LEAD}?\\d+|{LEAD}?(?:[^\\w{LEAD}]|_)+|{LEAD}")
CACHE = 400_000  # pre-tokens
BYTE_SCORE = -20.0  # score of a byte that no piece covers

ship(__name__)


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces with log-probabilities: rank r of the vocabulary has a share in proportion to 1 / r."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    return {model.id_to_piece(i): -math.log(r) - total for r, i in enumerate(ids, 1)}


def pre_tokens(text: str) -> list[str]:
    """Runs of letters, of digits and of other signs; the first of a word carries the blank before it."""
    joined = LEAD.join(text.split())
    return PRE_TOKEN.findall(LEAD + joined) if joined else []


def count_pieces(tokens: Iterable[str], vocabulary: dict[str, float], longest: int) -> dict[str, int]:
    """Pieces in the best segmentation of each distinct pre-token; of equally good ones the shortest."""
    counts: dict[str, int] = {}
    previous, scores, pieces = "", [0.0], [0]
    for token in sorted(set(tokens)):
        shared, least = 0, min(len(token), len(previous))
        while shared < least and token[shared] == previous[shared]:
            shared += 1
        del scores[shared + 1 :], pieces[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            size = len(token[end - 1].encode("utf-8", "surrogatepass"))
            best, number = scores[end - 1] + BYTE_SCORE * size, pieces[end - 1] + size
            for start in range(max(0, end - longest), end):
                score = vocabulary.get(token[start:end])
                if score is not None:
                    score += scores[start]
                    if score > best or (score == best and pieces[start] + 1 < number):
                        best, number = score, pieces[start] + 1
            scores.append(best)
            pieces.append(number)
        counts[token] = pieces[-1]
        previous = token
    return counts


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: dict[str, float] | None = None) -> DataFrame:
    """``(doc_id, n_pre_tokens, n_tokens)`` per row of ``docs``; null and empty texts have none, repeats stay."""
    pieces = read_vocabulary() if vocabulary is None else vocabulary
    longest = max(map(len, pieces), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(at, 256)
                split = [pre_tokens(value.as_py() or "") for value in part.column(1)]
                if len(known) > CACHE:
                    known.clear()
                fresh = set().union(*split).difference(known)
                known.update(count_pieces(fresh, pieces, longest))
                columns = [part.column(0), pa.array(map(len, split), pa.int64()), pa.array([sum(map(known.__getitem__, s)) for s in split], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pre_tokens", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_pre_tokens bigint, n_tokens bigint")
