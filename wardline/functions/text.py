"""Normalisers, classifiers and parsers of labels, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.scalars import label

#: Stages of a case by their folded label.
STAGES = {
    "under investigation": "under_investigation",
    "pending trial": "pending_trial",
    "traced": "traced",
    "un traced": "un_traced",
    "untraced": "un_traced",
    "undetected": "undetected",
    "convicted": "convicted",
    "dis/acq": "discharged_acquitted",
    "abated": "abated",
    "false case": "false_case",
    "compounded": "compounded",
    "boundover": "bound_over",
    "other disposal": "other_disposal",
}
#: Ranks of officers.
RANKS = ("PI", "PSI", "ASI", "HC", "PC", "CPI", "ACP", "DCP", "SI", "CHC", "WPC", "WHC")
#: Words that say a kind of premise, in the order in which they decide.
PREMISES = {
    "transit": r"bus\s*(?:stand|stop|depot)|railway|rly|metro|station|airport|terminal|depot",
    "public_institutional": "school|college|university|hospital|clinic|temple|church|mosque|masjid|dargah|math|govt|government|court|police|library|park|playground|stadium|anganwadi",
    "commercial": "shop|store|market|mall|hotel|lodge|bar|restaurant|bank|atm|showroom|complex|office|godown|garage|workshop|petrol|bunk|factory|industri|commercial|parking|theatre|cinema|wine|bakery|medical",
    "residential": "house|home|residence|residential|flat|apartment|apartments|quarters|nilaya|building|layout|colony|badavane",
    "intersection": r"junction|circle|signal|cross\s*road|crossing|underpass|flyover",
    "outdoor": r"road|rd|street|main|cross|highway|nh|sh|ring\s*road|orr|lane|footpath|bridge|nala|lake|ground|field|open|vacant",
}
#: Words that hint at a weapon.
WEAPONS = {
    "firearm": "GUN|PISTOL|REVOLVER|FIREARM|RIFLE|ARMS ACT",
    "blade": "KNIFE|BLADE|SWORD|MACHETE|DAGGER",
    "blunt": "ROD|CLUB|STONE|STICK|BLUNT",
    "fire_or_chemical": "ACID|CHEMICAL|ARSON|FIRE|BURN",
    "vehicle": "VEHICLE|AUTOMOBILE|MOTOR|CAR|BIKE|SCOOTER|TWO WHEELER",
    "digital": "CYBER|INFORMATION TECHNOLOGY|ONLINE|PHONE|ACCOUNT",
    "restraint": "CONFINEMENT|RESTRAINT|KIDNAP|ABDUCTION",
}
OTHER_WEAPON = "WEAPON|DANGEROUS MEANS"
#: Words of a place that say nothing of it.
PLACE_STOP_WORDS = ("AND", "AT", "BY", "FRONT", "IN", "NEAR", "NO", "OF", "OPP", "OPPOSITE", "ROAD", "THE")
#: Bands of four hours, and severity weights by words of a head.
TIME_BANDS = ("late_night", "early_morning", "morning", "afternoon", "evening", "night")
SEVERITY = {1.5: "murder|rape|dacoity|terror|explosive", 1.25: "robbery|kidnap|automobile|weapon|sexual", 1.15: "information technology|cyber|dowry|criminal intimidation"}


#: A word's edge where only ASCII letters, digits and _ make words; what the engine takes for one varies by its version.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def edged(pattern: str) -> str:
    """The pattern with ASCII edges."""
    return pattern.replace(r"\b", EDGE)


def has(c: Column, pattern: str) -> Column:
    """Whether c matches one of a pattern's alternatives of plain words, with edges or .* between: the words are looked for first, as edges are costly to try at each place."""
    ways = [way.split(".*") for way in re.sub(r"\\b|\(\?:|\)", "", pattern).split("|")]
    there = [reduce(lambda a, b: a & b, [F.contains(c, F.lit(words)) for words in way]) for way in ways]
    return reduce(lambda a, b: a | b, there) & c.rlike(edged(pattern))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is worked out once: a lambda's body would work it out again for each element that it looks at."""
    return F.element_at(F.transform(F.array(c), use), 1)


def fold(c: Column) -> Column:
    """The key of a label for comparison."""
    return F.lower(label(c))


def normal_name(c: Column) -> Column:
    """A unit's name without accents, case, punctuation and words that all units have. Accents of Latin letters go."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    plain = F.regexp_replace(F.replace(plain, F.lit("&"), F.lit("and")), edged(r"\b(?:police|station|ps|traffic)\b"), "")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def stage(c: Column, strict: bool = True) -> Column:
    """struct<stage, transfer_target>; an unknown label is an error, or null where not strict."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    transfer = F.regexp_extract(raw, r"(?i)^transfer+ed\s*:\s*UI\s*\((.*)\)\s*$", 1)
    moved = raw.rlike(r"(?i)^transfer+ed\s*:\s*UI\s*\(.*\)\s*$")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), F.lower(F.regexp_replace(raw, r"\s+", " ")))
    unknown = F.raise_error(F.concat(F.lit("unmapped stage: "), raw)).cast("string") if strict else F.lit(None).cast("string")
    return F.struct(F.when(moved, "transferred").otherwise(F.coalesce(known, unknown)).alias("stage"), F.when(moved, F.nullif(F.trim(transfer), F.lit(""))).alias("transfer_target"))


def complaint_mode(c: Column) -> Column:
    """struct<mode, is_organised, is_online>."""
    value, suffix = label(F.coalesce(c, F.lit(""))), r"(?i)\s*&\s*Organised$"
    mode = F.trim(F.regexp_replace(value, suffix, ""))
    return F.struct(mode.alias("mode"), value.rlike(suffix).alias("is_organised"), (F.lower(mode) == "online").alias("is_online"))


def officer_id(c: Column) -> Column:
    """An officer's number without a trailing .0; null if it isn't one."""
    plain = F.regexp_replace(F.trim(c), r"\.0+$", "")
    return F.when(plain.rlike("^[0-9]+$"), plain)


def officer(c: Column) -> Column:
    """struct<name, rank>."""
    value, pattern = label(F.coalesce(c, F.lit(""))), rf"(?i)^(.*?)\s*\(({'|'.join(RANKS)})\)\s*$"
    ranked = value.rlike(pattern)
    return F.struct(F.when(ranked, F.trim(F.regexp_extract(value, pattern, 1))).otherwise(value).alias("name"), F.when(ranked, F.upper(F.regexp_extract(value, pattern, 2))).alias("rank"))


def premise(c: Column) -> Column:
    """The kind of a place: the first rule that fits, outdoor where none does."""
    text = F.coalesce(c, F.lit(""))
    rules = iter(PREMISES.items())
    name, words = next(rules)
    first = F.when(text.rlike(edged(rf"(?i)\b(?:{words})\b")), name)
    return reduce(lambda acc, rule: acc.when(text.rlike(edged(rf"(?i)\b(?:{rule[1]})\b")), rule[0]), rules, first).otherwise("outdoor")


def weapons(text: Column) -> Column:
    """Hints of weapons, sorted."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    has = lambda words: upper.rlike(edged(rf"\b(?:{words})\b"))
    found = F.array_compact(F.array(*[F.when(has(words), name) for name, words in WEAPONS.items()]))
    return F.when(F.size(found) > 0, F.array_sort(found)).when(has(OTHER_WEAPON), F.array(F.lit("other_weapon"))).otherwise(found)


def premise_tokens(c: Column) -> Column:
    """Words of a place: three letters or more, no stop words, distinct, sorted, 24 at most."""
    words = F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z\s]", " "), r"\s+")
    return F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*PLACE_STOP_WORDS)))), 1, 24)


def sections(c: Column) -> Column:
    """array<struct<act, sections>> out of repeated groups `ACT U/s: s1,s2`; where a list of sections goes on into the next act, it ends at that."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    # An act that follows sections starts a piece of its own; so do the sections of each act.
    mark = F.regexp_replace(text, r"(?i) U/s: *", "\u0001")
    pieces = F.split(F.regexp_replace(mark, "\u0001([^\u0001]*?) (?=[A-Z][A-Z0-9 ,&.'()/-]{2,}(?:ACT|CODE|PROCEDURE)\\b[^\u0001]*\u0001)", "\u0001$1\u0002"), "\u0002")
    one = lambda p: F.struct(
        F.upper(F.trim(F.element_at(F.split(p, "\u0001"), 1))).alias("act"),
        F.filter(F.transform(F.split(F.element_at(F.split(p, "\u0001"), -1), ","), lambda s: F.upper(F.replace(s, F.lit(" "), F.lit("")))), lambda s: s.rlike("^[0-9A-Z][0-9A-Z().&/-]{0,31}$")).alias("sections"),
    )
    parsed = F.transform(F.filter(pieces, lambda p: F.contains(p, F.lit("\u0001"))), one)
    return F.filter(parsed, lambda a: (a["act"] != "") & (F.size(a["sections"]) > 0))


def section_tokens(acts: Column) -> Column:
    """ACT::SECTION of all, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(acts, lambda a: F.transform(a["sections"], lambda s: F.concat(a["act"], F.lit("::"), s))))))


def name_words(c: Column) -> Column:
    """A name's words, each once, without those of any station."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda t: (t != "") & ~t.isin("ps", "police", "station")))


def words_ratio(a: Column, b: Column) -> Column:
    """Overlap of two names' words (`name_words`) in any order; long words that begin alike count nine tenths. 0 if one has none."""

    def alike(t: Column, o: Column) -> Column:
        short, long_ = F.when(F.length(t) < F.length(o), t).otherwise(o), F.when(F.length(t) < F.length(o), o).otherwise(t)
        return (F.length(t) >= 5) & (F.length(o) >= 5) & F.startswith(long_, F.substring(short, 1, 6))

    shared = F.aggregate(a, F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains(b, t), 1.0).when(F.exists(b, lambda o: alike(t, o)), 0.9).otherwise(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * shared / (F.size(a) + F.size(b)))


def token_ratio(a: Column, b: Column) -> Column:
    """The ratio of two names' words."""
    return once(F.struct(name_words(a).alias("x"), name_words(b).alias("y")), lambda s: words_ratio(s["x"], s["y"]))


def name_keys(words: Column, asked: bool) -> Column:
    """For each of a name's words, what it meets words of other names by: two words count in the ratio if an asked key of one is a given key of the other. A key stands for one share, so names that have it lack none of it."""
    n = F.length
    first = lambda kind, k: lambda t: F.concat(F.lit(kind), F.substring(t, 1, k))
    whole, five, six, short = (lambda t: F.concat(F.lit("="), t)), first("5", 5), first("6", 6), first("f", 5)
    # Words of five letters are the beginning that a longer one is held to, longer ones are held to six.
    ways = [(whole, None), (six, lambda t: n(t) >= 6), (short, lambda t: n(t) >= 6), (five, lambda t: n(t) == 5)] if asked else [(whole, None), (six, lambda t: n(t) >= 6), (five, lambda t: n(t) >= 5), (short, lambda t: n(t) == 5)]
    return F.transform(words, lambda t: F.array_compact(F.array(*[key(t) if fits is None else F.when(fits(t), key(t)) for key, fits in ways])))


def key_pairs(keys: Column) -> Column:
    """Keys of two different words of `name_keys`, each pair in order."""
    one = lambda w, i: F.transform(w, lambda k: F.struct(i.alias("i"), k.alias("k")))
    all_ = F.flatten(F.transform(keys, one))
    later = lambda a, every: F.transform(F.filter(every, lambda b: b["i"] > a["i"]), lambda b: F.concat_ws("|", F.least(a["k"], b["k"]), F.greatest(a["k"], b["k"])))
    return F.array_distinct(once(all_, lambda every: F.flatten(F.transform(every, lambda a: later(a, every)))))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance of two normal names over the longer one; 0 if one is empty."""
    x, y = normal_name(a), normal_name(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def time_band(hour: Column) -> Column:
    """The band of four hours; null outside 0 to 23."""
    return F.when(hour.between(0, 23), F.element_at(F.array(*map(F.lit, TIME_BANDS)), (F.floor(hour / 4) + 1).cast("int")))


def victim_profile(male: Column, female: Column, boy: Column, girl: Column) -> Column:
    """Which victims there are, whether several, or none."""
    counts = {"male": male, "female": female, "boy": boy, "girl": girl}
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in counts.values()])
    return F.array_compact(F.array(*[F.when(c > 0, name) for name, c in counts.items()], F.when(total > 1, "multiple"), F.when(total == 0, "none")))


def severity_weight(head: Column) -> Column:
    """The weight of a head by its words; 1 where none is listed."""
    rules = iter(SEVERITY.items())
    weight, words = next(rules)
    return reduce(lambda acc, r: acc.when(F.lower(head).rlike(r[1]), r[0]), rules, F.when(F.lower(head).rlike(words), weight)).otherwise(1.0)


def one_hot(slots: Column, size: int) -> Column:
    """An array of size zeros with ones at slots."""
    at = F.sequence(F.lit(0), F.lit(size - 1))
    return once(slots, lambda known: F.transform(at, lambda i: F.when(F.array_contains(known, i.cast("long")), 1.0).otherwise(0.0)))


#: Words of an offence's group and head, and the category that the first of them to fit decides; none for the first.
CATEGORIES = (
    ("CYBER|MISSING PERSON", None),
    ("NARCOTIC|DRUG|NDPS", "drug_offence"),
    ("ARMS|WEAPON|EXPLOSIVE", "weapons_offence"),
    ("RAPE|MOLEST|POCSO|SEX|PORNOGRAPH|MODESTY", "sexual_offence"),
    ("CRUELTY|DOWRY|MARRIAGE|CHILD|INFANT|FAMILY", "family_child_offence"),
    ("ROBBERY|DACOITY|MURDER|HOMICIDE|HURT|ASSAULT|KIDNAP|CONFINEMENT", "violent_crime"),
    ("THEFT|BURGLARY|ARSON|MISCHIEF|STOLEN PROPERTY", "property_crime"),
    ("CHEAT|FRAUD|FORGER|COUNTERFEIT|BREACH OF TRUST|IMPERSONATION", "fraud_cyber_crime"),
    ("PUBLIC|POLICE ACT|CRPC|TRAFFIC|ACCIDENT|NEGLIGEN|RIOT|AFFRAY|TRESPASS|NUISANCE|COURT|ELECTION", "public_order"),
)
#: Words of a premise's description, its category and broad kind.
DONOR_PREMISES = (
    ("BUS|METRO|TRAIN|RAIL|AIRPORT|TRANSPORT|STATION|TERMINAL", "transit", "transit"),
    ("SINGLE FAMILY|MULTI-UNIT|APARTMENT|DWELLING|RESIDENCE|CONDOMINIUM|PORCH|YARD|GARAGE|CARPORT|HOTEL|MOTEL", "residential", "residential"),
    ("SCHOOL|COLLEGE|UNIVERSITY|HOSPITAL|CLINIC|CHURCH|TEMPLE|MOSQUE|GOVERNMENT|PARK|LIBRARY|COURT|POLICE|FIRE STATION", "public_institutional", "public_institutional"),
    ("STREET|SIDEWALK|ALLEY|DRIVEWAY|PARKING|BEACH|OPEN AREA|UNDERPASS|BRIDGE", "outdoor", "outdoor"),
    ("VEHICLE|TAXI|TRUCK|AUTOMOBILE", "vehicle", "outdoor"),
    ("STORE|SHOP|MARKET|BUSINESS|RESTAURANT|BAR|CAFE|BANK|OFFICE|MALL|THEATRE|WAREHOUSE|FACTORY|PHARMACY|GAS STATION", "commercial", "commercial"),
)
#: Words of a weapon's description and its kind.
DONOR_WEAPONS = (
    ("GUN|RIFLE|SHOTGUN|REVOLVER|PISTOL|FIREARM", "firearm"),
    ("KNIFE|BLADE|MACHETE|SWORD|SCISSORS|RAZOR", "sharp_object"),
    ("CLUB|BAT|STICK|ROD|HAMMER|BLUNT|BRASS KNUCKLES", "blunt_object"),
    ("VEHICLE", "vehicle"),
    ("BOMB|EXPLOSIVE", "explosive"),
    ("CHEMICAL|POISON|GAS|FIRE|BURN", "chemical_or_fire"),
    ("HANDS|FIST|FEET|BODILY FORCE", "physical_force"),
)
#: A case's status and a victim's sex by their codes.
DONOR_STATUS = {"IC": "under_investigation", "AA": "arrest_made", "JA": "arrest_made", "AO": "closed_other", "JO": "closed_other", "CC": "unknown", "": "unknown"}
DONOR_SEX = {"M": "male", "F": "female", "X": "other_or_unknown", "H": "other_or_unknown", "-": "other_or_unknown", "": "unknown"}


def _first(c: Column, rules: list[tuple[str, Column]], otherwise: Column) -> Column:
    """The value of the first rule whose words stand in c."""
    words, value = rules[0]
    found = lambda words: has(c, rf"\b(?:{words})\b")
    return reduce(lambda acc, r: acc.when(found(r[0]), r[1]), rules[1:], F.when(found(words), value)).otherwise(otherwise)


def donor_category(group: Column, head: Column) -> Column:
    """The category of an offence; null for cyber offences and missing people."""
    c = F.upper(F.concat_ws(" ", F.coalesce(group, F.lit("")), F.coalesce(head, F.lit(""))))
    return once(c, lambda text: _first(text, [(words, F.lit(name).cast("string")) for words, name in CATEGORIES], F.lit("other_incident")))


def donor_premise(c: Column) -> Column:
    """struct<category, broad> of a premise's description."""
    kind = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("broad"))
    found = lambda text: _first(text, [(words, kind(a, b)) for words, a, b in DONOR_PREMISES], kind("built_other", "built_other"))
    return once(F.upper(F.coalesce(c, F.lit(""))), lambda text: F.when(text == "", kind("unknown", "built_other")).otherwise(found(text)))


def donor_weapon(c: Column) -> Column:
    """The kind of a weapon; '' where nothing is said."""
    found = lambda text: _first(text, [(words, F.lit(name)) for words, name in DONOR_WEAPONS], F.lit("other_weapon"))
    return once(F.upper(F.coalesce(c, F.lit(""))), lambda text: F.when(text == "", "").otherwise(found(text)))


def _by_code(c: Column, known: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.coalesce(c, F.lit("")))


def donor_status(c: Column) -> Column:
    """A case's status by its code; null for one that isn't listed."""
    return _by_code(c, DONOR_STATUS)


def donor_sex(c: Column) -> Column:
    """A victim's sex by its code."""
    return F.coalesce(_by_code(c, DONOR_SEX), F.lit("other_or_unknown"))


#: Patterns of an offence's description in the order in which they decide, its category and subcategory.
CRIMES = (
    (r"\b(?:HOMICIDE|MANSLAUGHTER)\b", "violent_crime", "homicide"),
    (r"\bHUMAN TRAFFICKING\b", "violent_crime", "human_trafficking"),
    (r"\b(?:CHILD NEGLECT|CHILD ABUSE|CHILD PORNOGRAPHY|CHILD ABANDONMENT|CHILD STEALING|CHILD ANNOYING|CRM AGNST CHLD|CONTRIBUTING)\b", "family_child_offence", "child_related_offence"),
    (r"\b(?:INTIMATE PARTNER|DOMESTIC)\b", "family_child_offence", "domestic_violence"),
    (r"\b(?:RAPE|SEX|SEXUAL|SODOMY|LEWD|INDECENT|ORAL COPULATION|PENETRATION)\b", "sexual_offence", "sexual_offence"),
    (r"\b(?:PIMPING|PANDERING)\b", "sexual_offence", "sexual_exploitation"),
    (r"\b(?:KIDNAPP|ABDUCTION)", "violent_crime", "kidnapping"),
    (r"\bFALSE IMPRISONMENT\b", "violent_crime", "unlawful_confinement"),
    (r"\bROBBERY\b", "violent_crime", "robbery"),
    (r"\bASSAULT|BATTERY|SHOTS FIRED|DISCHARGE FIREARM|LYNCHING|THROWING OBJECT\b", "violent_crime", "assault"),
    (r"\bARSON\b", "property_crime", "arson"),
    (r"\bBURGLARY\b", "property_crime", "burglary"),
    (r"\bVEHICLE-RELATED\b", "property_crime", "vehicle_related_offence"),
    (r"\bVEHICLE\b.*\bSTOLEN\b|\bSTOLEN VEHICLE\b", "property_crime", "vehicle_theft"),
    (r"\bIDENTITY|FRAUD|FORGERY|COUNTERFEIT|EMBEZZLEMENT|CREDIT CARD|EXTORTION|BUNCO|DOCUMENT WORTHLESS|DEFRAUDING\b", "fraud_cyber_crime", "fraud"),
    (r"\bCYBER|COMPUTER|ELECTRONIC\b", "fraud_cyber_crime", "cybercrime"),
    (r"\bTHEFT FROM MOTOR VEHICLE\b", "property_crime", "theft_from_vehicle"),
    (r"\bSHOPLIFT", "property_crime", "shoplifting"),
    (r"\bTHEFT|STOLEN|PICKPOCKET|PURSE SNATCH|BIKE|DRUNK ROLL|TILL TAP\b", "property_crime", "theft"),
    (r"\bVANDALISM|DAMAGE|TRAIN WRECK\b", "property_crime", "property_damage"),
    (r"\bWEAPON|FIREARM|BOMB|EXPLOSIVE\b", "weapons_offence", "weapons_offence"),
    (r"\bDRUG|NARCOTIC\b", "drug_offence", "drug_offence"),
    (r"\bTRESPASS", "public_order", "trespass"),
    (r"\bTHREAT|STALK|HARASS\b", "public_order", "threat_or_harassment"),
    (r"\bRESTRAINING ORDER|COURT ORDER|CONTEMPT|PROTECTIVE ORDER|REGISTRANT OUT OF COMPLIANCE\b", "public_order", "order_violation"),
    (r"\b(?:RECKLESS DRIVING|FAILURE TO YIELD|DRIVING WITHOUT OWNER CONSENT)\b", "public_order", "traffic_offence"),
    (r"\b(?:RESISTING ARREST|FALSE POLICE REPORT|BRIBERY|CONSPIRACY)\b", "public_order", "justice_or_corruption_offence"),
    (r"\b(?:RIOT|FAILURE TO DISPERSE|DISTURBING THE PEACE|DISRUPT SCHOOL|BLOCKING DOOR)\b", "public_order", "public_disorder"),
    (r"\b(?:PEEPING TOM|PROWLER|LETTERS, LEWD)\b", "public_order", "privacy_or_harassment_offence"),
    (r"\bILLEGAL DUMPING\b", "public_order", "illegal_dumping"),
    (r"\bCRUELTY TO ANIMALS|BEASTIALITY\b", "other_incident", "animal_related_offence"),
    (r"\bBIGAMY|INCEST\b", "family_child_offence", "family_related_offence"),
    (r"\bMISSING\b", "other_incident", "missing_person"),
)
#: What a label loses, in order: amounts, degrees, and then all but letters and digits.
LABEL_CUTS = ((r"(?i)\$\s*[\d,.]+(?:\s*&?\s*(?:OVER|UNDER))?", ""), (r"(?i)\b(?:FELONY|MISDEMEANOR|GRAND|PETTY)\b", ""), (r"\s+", " "), (r"\s+([,;:)])", "$1"), (r"[(]\s*[)]", ""))


def clean_label(c: Column) -> Column:
    """A description as a name: without amounts and degrees, small letters and digits with _ between."""
    def cut(acc: Column, rule: tuple[str, str]) -> Column:
        words = re.findall("[A-Z]{4,}", rule[0]) if r"\b" in rule[0] else []
        done = F.regexp_replace(acc, edged(rule[0]), rule[1])
        # Words with edges are looked for first; other cuts are cheap.
        return once(acc, lambda x: F.when(has(F.upper(x), "|".join(words)), F.regexp_replace(x, edged(rule[0]), rule[1])).otherwise(x)) if words else done

    plain = reduce(cut, LABEL_CUTS, F.coalesce(c, F.lit("")))
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(plain)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def donor_crime(c: Column) -> Column:
    """struct<category, subcategory> of an offence's description; what no pattern fits is an incident named by its label."""
    def found(upper: Column) -> Column:
        def kind(a: str, b: str) -> Column:
            stolen = F.contains(upper, F.lit("VEHICLE")) & F.lit(b == "burglary")
            return F.struct(F.lit(a).alias("category"), F.when(stolen, "theft_from_vehicle").otherwise(b).alias("subcategory"))

        other = F.struct(F.lit("other_incident").alias("category"), F.coalesce(F.nullif(clean_label(c), F.lit("")), F.lit("other")).alias("subcategory"))
        return reduce(lambda acc, r: acc.when(has(upper, r[0]), kind(*r[1:])), CRIMES[1:], F.when(has(upper, CRIMES[0][0]), kind(*CRIMES[0][1:]))).otherwise(other)

    return once(F.upper(F.coalesce(c, F.lit(""))), found)
