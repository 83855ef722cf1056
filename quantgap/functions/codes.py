"""Survey codes and labels.

Everything in this module is a fixed value: results depend on these words and numbers being exactly these.
"""

from __future__ import annotations

from quantgap.functions.levels import Levels


def numbered(text: str) -> tuple[tuple[int, str], ...]:
    """``code label`` lines."""
    pairs = (line.strip().split(" ", 1) for line in text.strip().splitlines())
    return tuple((int(code), label) for code, label in pairs)


def as_levels(text: str) -> Levels:
    pairs = numbered(text)
    return Levels(tuple(label for _, label in pairs), tuple(code for code, _ in pairs))


# Raw codes and their labels.
SEX = Levels(("Homme", "Femme"))
WORK_TIME = Levels(("Temps complet", "Temps partiel"))
ACTIVITY_1982 = Levels(
    (
        "Actif occupé",
        "Chômeur",
        "Etudiant",
        "Militaire du contingent",
        "Retraité",
        "Retiré des affaires",
        "Femme au foyer",
        "Autre inactif",
    )
)
STATUS = Levels(("En emploi", "Chômeur", "Retraite", "Etudes", "Au foyer", "Autres inactifs"))
HOUSEHOLD = Levels(("Célibataire", "Ménage complexe", "Monoparent", "Couple sans enfant", "Couple avec enfant(s)"))
HOUSEHOLD_RENAMED = {
    "Femme seule": "Célibataire",
    "Autre": "Ménage complexe",
    "Famille monoparentale": "Monoparent",
    "Couple avec enfant (s)": "Couple avec enfant(s)",
    "6": None,
    "9": None,
}

OCCUPATION_DETAIL = as_levels(
    """
    11 agriculteurs sur petite exploitation
    12 agriculteurs sur moyenne exploitation
    13 agriculteurs sur grande exploitation
    21 artisans
    22 commerçants et assimilés
    23 chefs d'entreprise de 10 salariés ou plus
    31 professions libérales
    33 cadres de la fonction publique
    34 professeurs, professions scientifiques
    35 professions de l'information, des arts et des spectacles
    37 cadres administratifs et commerciaux d'entreprises
    38 ingénieurs et cadres techniques d'entreprises
    42 instituteurs et assimilés
    43 professions intermédiaires de la santé et du travail social
    44 clergé, religieux
    45 professions intermédiaires administratives de la fonction publique
    46 professions intermédiaires administratives et commerciales des entreprises
    47 techniciens
    48 contremaîtres, agents de maîtrise
    52 employés civils et agents de service de la fonction publique
    53 policiers et militaires
    54 employés administratifs d'entreprises
    55 employés de commerce
    56 personnels des services directs aux particuliers
    62 ouvriers qualifiés de type industriel
    63 ouvriers qualifiés de type artisanal
    64 chauffeurs
    65 ouvriers qualifiés de la manutention, du magasinage et du transport
    67 ouvriers non qualifiés de type industriel
    68 ouvriers non qualifiés de type artisanal
    69 ouvriers agricoles
    71 anciens agriculteurs exploitants
    72 anciens artisans, commerçants, chefs d'entreprise
    74 anciens cadres
    75 anciennes professions intermédiaires
    77 anciens employés
    78 anciens ouvriers
    81 chômeurs n'ayant jamais travaillé
    83 militaires du contingent
    84 élèves, étudiants
    85 personnes diverses sans activité professionnelle de moins de 60 ans (sauf retraités)
    86 personnes diverses sans activité professionnelle de 60 ans et plus (sauf retraités)
    """
)
# The parents' list is the detailed list with farmers in one code and without former workers and the inactive.
_parents = [(10, "agriculteurs exploitants")] + [(c, t) for c, t in zip(OCCUPATION_DETAIL.codes, OCCUPATION_DETAIL.labels) if 21 <= c <= 69]
OCCUPATION_PARENT = Levels(tuple(t for _, t in _parents), tuple(c for c, _ in _parents))

SECTOR = as_levels(
    """
    1 Agriculture, sylviculture, pêche (SECT38=01)
    2 Industries agricoles et alimentaires (SECT38=02,03)
    3 Energie (SECT38=04,05,06)
    4 Industrie des biens intermédiaires (SECT38=07 à 11,13,21,23)
    5 Industrie des biens d'équipement (SECT38=14 à 17)
    6 Industrie des biens de consommation courante (SECT38=12,18 à 20,22)
    7 Bâtiment, génie civil et agricole (SECT38=24)
    8 Commerce (SECT38=25 à 28)
    9 Transports et télécommunications (SECT38=31,32)
    10 Services marchands (SECT38=29,30,33,34)
    11 Location et crédit bail immobiliers (SECT38=35)
    12 Assurances (SECT38=36)
    13 Organismes financiers (SECT38=37)
    14 Services non marchands
    """
)
DIPLOMA_1982 = as_levels(
    """
    10 2ème ou 3ème cycle universitaire
    11 grande école, diplôme d'ingénieur
    30 1er cycle universitaire
    31 BTS, DUT
    32 paramédical ou social avec baccalauréat général
    33 paramédical ou social sans baccalauréat général
    40 baccalauréat général et diplôme technique secondaire
    41 baccalauréat général seul
    42 baccalauréat technologique, BAC pro. et brevet professionnel
    43 BEI, BEC, BEA
    50 CAP, BEP, et BEPC
    51 CAP, BEP seul
    60 BEPC seul
    70 CEP
    71 aucun diplôme
    """
)

# Seven occupation classes in order, with their short names as social origin.
CLASSES = Levels(
    (
        "Agriculteurs",
        "Artisans, commerçants, chefs d'entreprise",
        "Cadres et professions intellectuelles",
        "Professions intermédiaires",
        "Employés",
        "Ouvriers",
        "Inactifs (n'ayant jamais travaillé)",
    )
)
ORIGIN_NAMES = dict(zip(CLASSES.labels, ("Agriculteur", "ACCE", "Cadre", "Pinter", "Employé", "Ouvrier")))
# Ordered pattern rules, then exact titles.
CLASS_PATTERNS = (
    ("[Aa]griculteur", "Agriculteurs"),
    ("intermédiaire", "Professions intermédiaires"),
    ("[Oo]uvrier", "Ouvriers"),
    ("[Ee]mployé", "Employés"),
    ("[Aa]rtisan|[Cc]ommerçant|[Cc]hef", "Artisans, commerçants, chefs d'entreprise"),
    ("[Cc]adre", "Cadres et professions intellectuelles"),
)
CLASS_TITLES = {
    "Ouvriers": ["Chauffeurs"],
    "Professions intermédiaires": [
        "Professeurs des écoles, instituteurs et professions assimilées",
        "Clergé, religieux",
        "Contremaîtres, agents de maîtrise",
        "Techniciens",
    ],
    "Inactifs (n'ayant jamais travaillé)": [
        "Chômeurs n'ayant jamais travaillé",
        "Personnes diverses sans activité professionnelle de moins de 60 ans (sauf retraités)",
        "Personnes diverses sans activité professionnelle de 60 ans et plus (sauf retraités)",
        "Militaires du contingent",
        "Elèves, étudiants",
        "Inactifs divers (autres que retraités)",
    ],
    "Employés": ["Personnels des services directs aux particuliers", "Policiers et militaires"],
    "Cadres et professions intellectuelles": [
        "Professeurs, professions scientifiques",
        "Professions de l'information, des arts et des spectacles",
        "Professions libérales",
    ],
}
OWN_TITLE_FIXES = {
    "Elèves, étudiants": ["Élèves, étudiants"],
    "Employés administratifs d'entreprise": ["Employés administratifs d'entreprises"],
    "Professeurs des écoles, instituteurs et professions assimilées": ["Instituteurs et assimilés"],
}
PARENT_TITLE_FIXES = {
    "Elèves, étudiants": ["84"],
    "Inactifs divers (autres que retraités)": ["85", "86"],
    "Employés administratifs d'entreprise": ["Employés administratifs d'entreprises"],
    "Ouvriers agricoles et assimilés": ["Ouvriers agricoles"],
    "Professeurs des écoles, instituteurs et professions assimilées": ["Instituteurs et assimilés"],
}

# Diploma codes of 1982 in the coding of 1990 (general, technical, higher).
GENERAL_1982 = {"00": ["0"], "02": ["1"], "15": ["3"], "18": ["4"], "16": ["6"], "17": ["7"], "19": ["8"]}
TECHNICAL_1982 = {"": [""], "23": ["2", "3", "4"], "21": ["5"], "29": ["6"], "36": ["7", "9"], "39": ["8"]}
HIGHER_1982 = {"41": ["1"], "45": ["2"], "43": ["3", "4"], "44": ["5"], "46": ["6"], "48": ["7"], "47": ["8"], "49": ["9"]}

# Highest code to diploma in 13 levels.
DIPLOMA_13 = Levels(
    (
        "Aucun diplôme",
        "CEP",
        "Brevet des collèges",
        "CAP/BEP",
        "Brevet technicien",
        "Baccalauréat pro",
        "Baccalauréat techno",
        "Baccalauréat général",
        "Capacité/DAEU",
        "Bac+2",
        "Licence/Maîtrise",
        "3e cycle/Tout doctorat",
        "Grande école",
    )
)
DIPLOMA_FROM_1990 = {
    "3e cycle/Tout doctorat": [47],
    "Grande école": [48, 49],
    "Licence/Maîtrise": [46],
    "Bac+2": [41, 42, 43, 44, 45],
    "Capacité/DAEU": [40],
    "Baccalauréat général": [17],
    "Baccalauréat techno": [32],
    "Baccalauréat pro": [34],
    "Brevet technicien": [36, 39],
    "CAP/BEP": [21, 23, 25, 27, 29],
    "Brevet des collèges": [15, 16, 18, 19],
    "CEP": [2],
    "Aucun diplôme": [0],
}
DIPLOMA_17 = Levels(
    (
        "Aucun diplôme",
        "CEP",
        "Brevet des collèges",
        "CAP/BEP",
        "Brevet technicien",
        "Baccalauréat pro",
        "Baccalauréat techno",
        "Baccalauréat général",
        "Capacité/DAEU",
        "Bac+2",
        "Autres Bac+3 et plus",
        "Licence",
        "Maîtrise",
        "Master/DESS/DEA",
        "Grande école",
        "Doctorat de santé",
        "Doctorat sauf santé",
    )
)
DIPLOMA_FROM_2013 = {
    "Doctorat sauf santé": [11],
    "Doctorat de santé": [12],
    "Grande école": [13, 14],
    "Master/DESS/DEA": [15, 16, 17, 18],
    "Maîtrise": [21],
    "Licence": [22, 23],
    "Autres Bac+3 et plus": [24],
    "Bac+2": [31, 32, 33, 34, 35, 36],
    "Capacité/DAEU": [41],
    "Baccalauréat général": [42],
    "Baccalauréat techno": [43],
    "Baccalauréat pro": [44],
    "Brevet technicien": [45],
    "CAP/BEP": [51, 52, 53],
    "Brevet des collèges": [60],
    "CEP": [70],
    "Aucun diplôme": [71],
}
DIPLOMA_FROM_2003 = {
    "Doctorat sauf santé": [71],
    "Doctorat de santé": [72],
    "Grande école": [63, 64],
    "Master/DESS/DEA": [61, 62],
    "Maîtrise": [53],
    "Licence": [51],
    "Autres Bac+3 et plus": [55],
    "Bac+2": [41, 42, 43, 44, 46],
    "Capacité/DAEU": [40],
    "Baccalauréat général": [17],
    "Baccalauréat techno": [32],
    "Baccalauréat pro": [34],
    "Brevet technicien": [33, 35, 36],
    "CAP/BEP": [21, 23, 24, 25, 27, 28, 29],
    "Brevet des collèges": [15],
    "CEP": [2],
    "Aucun diplôme": [0],
}
# 17 levels to 13, 13 to 7 codes, 13 to 10.
DIPLOMA_17_TO_13 = {
    "Licence/Maîtrise": ["Autres Bac+3 et plus", "Licence", "Maîtrise"],
    "3e cycle/Tout doctorat": ["Master/DESS/DEA", "Doctorat de santé", "Doctorat sauf santé"],
}
DIPLOMA_13_TO_7 = {
    7: ["Aucun diplôme", "CEP"],
    6: ["Brevet des collèges"],
    5: ["CAP/BEP"],
    4: ["Brevet technicien", "Baccalauréat techno", "Baccalauréat pro", "Baccalauréat général"],
    3: ["Capacité/DAEU", "Bac+2"],
    2: ["Licence/Maîtrise"],
    1: ["3e cycle/Tout doctorat", "Grande école"],
}
DIPLOMA_13_TO_10 = {
    "Brevet technicien": "Baccalauréat techno",
    "Capacité/DAEU": "Bac+2",
    "3e cycle/Tout doctorat": "Grande école/3e cycle/Tout doctorat",
    "Grande école": "Grande école/3e cycle/Tout doctorat",
}
DIPLOMA_10 = DIPLOMA_13.recoded(DIPLOMA_13_TO_10).moved("Baccalauréat techno", after=5)

# Activity status by era (raw code to status code) and marital status from 2021.
STATUS_FROM_1982 = {1: [1], 2: [2], 4: [3], 6: [4, 8], 3: [5, 6], 5: [7]}
STATUS_FROM_2003 = {1: [1, 2, 3], 2: [4], 4: [5], 6: [6, 9], 3: [7], 5: [8]}
STATUS_FROM_2013 = {1: [1, 2], 4: [3], 2: [4], 3: [5], 6: [6, 8, 9], 5: [7]}
STATUS_FROM_2021 = {1: [1], 2: [2], 3: [3], 6: [4, 7, 9], 4: [5], 5: [6]}
MARITAL_FROM_2021 = {2: [1, 2, 3], 3: [4], 4: [5, 6, 7], 1: [8]}

# Wage brackets in francs, closed on the right; the last is open.
BRACKET_LIMITS = tuple(range(1000, 5001, 500)) + tuple(range(6000, 10001, 1000)) + tuple(range(15000, 30001, 5000))
BRACKET_TOP_LIMIT = 50000
BRACKET_REFUSED = "Refus de répondre"
BRACKET_LABELS = tuple(
    f"De {low} à {high} francs" for low, high in zip((0,) + BRACKET_LIMITS, BRACKET_LIMITS)
) + ("Plus de 30000 francs",)
BRACKET_LETTERS = tuple("ABCDEFGHIJKLMNOPQRS") + ("X",)
BRACKETS = Levels(BRACKET_LABELS + (BRACKET_REFUSED,), BRACKET_LETTERS)

# Character repairs of the 2003 dictionary.
CHARACTER_REPAIRS = {"‚": "é", "“": "ô", "Š": "è", "…": "à", "Œ": "î"}
# The printable characters of code page 1252 between 0x80 and 0x9F, where ISO 8859-1 has controls.
CP1252_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰",
    0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}

# Detailed diploma codes.
DIPLOMA_DETAIL = as_levels(
    """
    100 Diplôme université bac+5
    110 Magistère
    111 Mastère spécialisé
    114 DRT
    120 DEA
    121 Master recherche
    130 DESS
    131 Master professionnel
    140 Master non différencié
    142 DNSEP depuis 2006
    145 BEES 3e degré
    150 Capacité médecine
    160 École sup. commerce (depuis 2000)
    164 Autre titre bac+5
    170 École ingénieur
    180 Prof. ens. secondaire (depuis 2010)
    188 Prof. écoles (depuis 2010)
    190 Agrégation (depuis 2010)
    194 Diplôme santé bac+5 (sage-femme)
    195 Docteur vétérinaire
    196 Doctorat santé
    197 Doctorat recherche
    198 Autre diplôme bac+5+
    200 Licence (L3)
    201 Maîtrise (M1)
    220 MST
    230 Maîtrise IUP
    240 DSAA
    241 DNAT/DNAP depuis 2006
    242 DNSEP jusqu'à 2005
    245 BEES 2e degré/Desjeps
    246 DESE/DEST Cnam
    250 Licence pro/BUT
    256 Diplôme université bac+3/4
    258 Drea
    260 École sup. commerce (jusqu'à 1999)
    264 Autre titre bac+3/4
    280 Prof. ens. secondaire IUFM
    288 Prof. écoles IUFM
    290 Agrégation (jusqu'à 2009)
    296 Diplôme santé bac+3/4 (infirmière)
    298 Autre diplôme bac+3/4
    320 BTS
    321 DMA
    322 DTS/DNTS/DPECF
    323 BTSA
    335 Brevet maîtrise supérieur
    340 DNAT avant 2006
    342 DNAP avant 2006
    345 Dejeps
    346 DPCT/DPCE Cnam
    350 DUT
    351 Propédeutique
    352 Deug/PCEM
    355 Deust
    356 Diplôme université bac+2
    363 CSA bac+2
    364 Autre titre bac+2
    388 École normale instituteur
    396 Diplôme santé bac+2 (infirmière)
    398 Autre diplôme bac+2
    400 Bac pro
    401 BMA
    402 BTM
    403 Bac pro agricole
    406 BMS
    410 Brevet enseignement
    411 Brevet enseignement
    412 Brevet enseignement
    413 Brevet enseignement
    414 Brevet enseignement
    420 BT
    423 BTA
    430 Bac technologique
    433 Bac technologique agricole
    435 Brevet de maîtrise
    437 Mention complémentaire bac
    445 BEES 1er degré/BPJEPS
    450 BP
    453 BPA
    460 BSEC
    463 CSA niveau bac
    464 Autre titre niveau bac
    470 Bac général
    488 Capacité droit/DAEU
    490 Brevet supérieur
    496 Diplôme santé niveau bac
    498 Autre diplôme niveau bac
    500 CAP
    503 CAPA
    510 BEP
    513 BEPA
    523 BAA
    532 BC
    537 Mention complémentaire CAP-BEP
    540 CFES
    545 Brevet élémentaire/BEPS
    553 BPA niveau CAP
    556 EFAA
    563 CSA niveau CAP-BEP
    564 Titre niveau CAP-BEP
    596 Diplôme santé CAP-BEP
    598 Autre diplôme CAP-BEP
    640 Brevet collèges
    641 CEPRO
    740 Certificat études primaires
    751 CFG
    799 Aucun diplôme
    """
)

# Variable names by era and type; None where a variable is absent.
CROSSWALK = (
    # final name, 2003-2012, 2013-2020, from 2021, type
    ("ANNEE", "ANNEE", "ANNEE", "ANNEE", "int"),
    ("RGA", "RGA", "RGA", "RGA", "int"),
    ("EXTRI", "EXTRI", "extri", "EXTRI", "chr"),
    ("SEXE", "SEXE", "SEXE", "SEXE", "int"),
    ("AG", "AG", "AG", "AG", "int"),
    ("CSTOT", "CSTOT", "CSTOT", "PCS2", "int"),
    ("MATRI", "MATRI", "MATRI", "ETAMATRI_Y", "int"),
    ("CSPP", "CSPP", "CSPP", "PCSPAR1_2", "int"),
    ("CSPM", "CSPM", "CSPM", "PCSPAR2_2", "int"),
    ("SEXE_PAR1", None, None, "SEXE_PAR1", "int"),
    ("SEXE_PAR2", None, None, "SEXE_PAR2", "int"),
    ("DIP_long", None, "DIPFIN", "DIP108", "int"),
    ("DIP_moyen", None, "DIPDET", "DIP29", "int"),
    ("DIP_court", "DIP", "DIP", "DIP7", "int"),
    ("DIPGEN", "DIPGEN", None, None, "int"),
    ("DIPTEC", "DIPTEC", None, None, "int"),
    ("DIPSUP", "DIPSUP", None, None, "int"),
    ("SAL", "SALRED", "SALRED", "SALRED_Y", "num"),
    ("TYPMEN", "TYPMEN5", "TYPMEN7", "TYPMEN5", "int"),
    ("SP00", "SP00", "SP00", "SPR00", "int"),
    ("TPPRED", "TPPRED", "TPPRED", "TPPRED", "int"),
)
CROSSWALK_ERAS = ("pre2013", "post2013", "post2021")
WAVES_1982 = ("AG", "CSTOT", "CSPP", "DIEG", "DIEP", "DIES", "DIPL", "EXTRI", "FI", "NA", "RANSECH", "S", "SALTR", "SECT14", "STATUT", "TYPMENR")
WAVES_1990 = ("AG", "CSTOT", "CSPP", "DIEG", "DIES", "DIET", "DIPL", "EXTRI", "FI", "TP", "RANSECH", "S", "SALRED", "SECT14", "STATUT", "TYMEN90R")
