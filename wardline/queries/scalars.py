"""Scalar functions over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalogue import _hmac, query
from wardline.functions import hashing as H
from wardline.functions import scalars as S
from wardline.functions import text as T
from wardline.plans import signatures
from wardline.sources.scratch import Store
from wardline.sources.tables import table


def _labels(table_name: str, key: str, texts: tuple[str | None, ...], more: str | None = None) -> str:
    """Rows of a table with a label each, as forms write it: one of the texts by the key's remainder, and more after it."""
    quoted = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts)
    raw = f"[{quoted}][{key} % {len(texts)} + 1]"
    return f"(SELECT {key} AS k, {raw if more is None else f"{raw} || ' ' || {more}"} AS raw FROM {table_name})"


def _labelled(spark: SparkSession, d: str, table_name: str, key: str, texts: tuple[str | None, ...], more: str | None = None) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int"))
    return table(spark, d, table_name).select(F.col(key).alias("k"), (raw if more is None else F.concat(raw, F.lit(" "), F.col(more))).alias("raw"))


_STAGE = (" Under  Investigation", "PENDING TRIAL", "traced", "Un Traced", "UnTraced", "dis/acq", "BoundOver", "Transfered :UI( CCB City Police)", "TRANSFERRED : ui ()", "False Case", "Other disposal")


@query(
    f"""WITH r AS (SELECT k, trim(raw) AS v FROM {_labels("orders", "o_orderkey", _STAGE)})
    SELECT k, CASE WHEN regexp_matches(v, '(?i)^transfer+ed\\s*:\\s*UI\\s*\\(.*\\)\\s*$') THEN 'transferred' ELSE CASE lower(regexp_replace(v, '\\s+', ' ', 'g')) {" ".join(f"WHEN '{k}' THEN '{x}'" for k, x in T.STAGES.items())} END END AS stage,
      nullif(trim(regexp_extract(v, '(?i)^transfer+ed\\s*:\\s*UI\\s*\\((.*)\\)\\s*$', 1)), '') AS transfer_target FROM r"""
)
def stage_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d, "orders", "o_orderkey", _STAGE).withColumn("s", T.stage(F.col("raw"))).select("k", "s.stage", "s.transfer_target")


_LABELS = (" CYBER  CRIME", "Online & Organised", "online", "Written &organised", "R S BIRADAR   (PI)", "Asha Rao (psi) ", "Plain Name", "12345.0", "0042", "12.5", "", "3.0", "-2", "x7")


@query(
    rf"""SELECT k, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS label, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS folded, trim(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '(?i)\s*&\s*Organised$', '')) AS mode,
      regexp_matches(trim(regexp_replace(raw, '\s+', ' ', 'g')), '(?i)\s*&\s*Organised$') AS is_organised,
      CASE WHEN regexp_full_match(regexp_replace(trim(raw), '\.0+$', ''), '[0-9]+') THEN regexp_replace(trim(raw), '\.0+$', '') END AS officer_id,
      CASE WHEN trim(raw) = '' THEN 0 WHEN regexp_full_match(regexp_replace(trim(raw), '\.0+$', ''), '[0-9]+') THEN regexp_replace(trim(raw), '\.0+$', '')::BIGINT END AS n,
      nullif(upper(regexp_extract(trim(raw), '(?i)\(({"|".join(T.RANKS)})\)$', 1)), '') AS rank FROM {_labels("customer", "c_custkey", _LABELS)}"""
)
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    rows = _labelled(spark, d, "customer", "c_custkey", _LABELS).withColumn("m", T.complaint_mode(raw)).withColumn("o", T.officer(raw))
    return rows.select("k", S.label(raw).alias("label"), T.fold(raw).alias("folded"), "m.mode", "m.is_organised", T.officer_id(raw).alias("officer_id"), S.count_of(raw).alias("n"), "o.rank")


_PLACES = ("Near Majestic Bus Stand, Main Road", "Govt School, 5th Cross", "SBI ATM MG Road", "No 5 Lake View Apartments", "Silk Board Junction", "Outer Ring  Road", "nowhere in particular", "METRO pillar 12", "Temple Street market", None, "", "house opposite to the police station")


@query(
    f"""SELECT k, CASE {" ".join(f"WHEN regexp_matches(coalesce(raw, ''), '(?i)\\b(?:{w})\\b') THEN '{k}'" for k, w in T.PREMISES.items())} ELSE 'outdoor' END AS premise,
      array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(upper(coalesce(raw, '')), '[^A-Z\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in T.PLACE_STOP_WORDS)}))))[1:24], ' ') AS tokens FROM {_labels("clients", "client_id", _PLACES, "city")}"""
)
def premise_class(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return _labelled(spark, d, "clients", "client_id", _PLACES, "city").select("k", T.premise(raw).alias("premise"), F.array_join(T.premise_tokens(raw), " ").alias("tokens"))


_ARMS = ("ARMS ACT 1959 U/s: 25", "robbery with knife and car", "stone and stick", "cyber phone account", "dangerous means", "dangerous means and a gun", "burn by acid", "nothing", "two wheeler kidnap", "Murder", "dowry", "automobile theft")


@query(
    f"""SELECT k, coalesce(nullif(array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(upper(raw), '\\b(?:{w})\\b') THEN '{k}' END" for k, w in T.WEAPONS.items())}], lambda x: x IS NOT NULL)), ' '), ''),
      CASE WHEN regexp_matches(upper(raw), '\\b(?:{T.OTHER_WEAPON})\\b') THEN 'other_weapon' ELSE '' END) AS hints, CAST(CASE {" ".join(f"WHEN regexp_matches(lower(raw), '{w}') THEN {k}" for k, w in T.SEVERITY.items())} ELSE 1 END AS DOUBLE) AS weight FROM {_labels("part", "p_partkey", _ARMS, "p_name")}"""
)
def weapon_hints(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return _labelled(spark, d, "part", "p_partkey", _ARMS, "p_name").select("k", F.array_join(T.weapons(raw), " ").alias("hints"), T.severity_weight(raw).alias("weight"))


@query("""SELECT p_partkey, upper(p_type) || ' ACT::' || p_size || ' ' || upper(p_brand) || ' CODE::' || (p_size + 1) || 'A ' || upper(p_brand) || ' CODE::' || (p_size + 2) AS tokens FROM (SELECT *, replace(p_brand, '#', '') AS b FROM part) WHERE p_size > 0""".replace("upper(p_brand)", "upper(b)").replace("SELECT p_partkey, upper(p_type) || ' ACT::' || p_size || ' ' || upper(b) || ' CODE::' || (p_size + 1) || 'A ' || upper(b) || ' CODE::' || (p_size + 2) AS tokens", "SELECT p_partkey, array_to_string(list_sort([upper(p_type) || ' ACT::' || p_size, upper(b) || ' CODE::' || (p_size + 1) || 'A', upper(b) || ' CODE::' || (p_size + 2)]), ' ') AS tokens"))
def section_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").filter("p_size > 0")
    brand, size = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size")
    text = F.concat(F.lower("p_type"), F.lit("  Act U/s: "), size.cast("string"), F.lit(" "), F.upper(brand), F.lit(" CODE u/s:"), (size + 1).cast("string"), F.lit("a , "), (size + 2).cast("string"), F.lit(",?!"))
    return rows.select("p_partkey", F.array_join(T.section_tokens(T.sections(text)), " ").alias("tokens"))


@query("""SELECT o_orderkey, CASE WHEN h BETWEEN 0 AND 23 THEN ['late_night', 'early_morning', 'morning', 'afternoon', 'evening', 'night'][h // 4 + 1] END AS band, array_to_string(list_filter([CASE WHEN a > 0 THEN 'male' END, CASE WHEN b > 0 THEN 'female' END, CASE WHEN c > 0 THEN 'boy' END, CASE WHEN e > 0 THEN 'girl' END,
      CASE WHEN a + b + c + e > 1 THEN 'multiple' END, CASE WHEN a + b + c + e = 0 THEN 'none' END], lambda x: x IS NOT NULL), ' ') AS victims, lpad(h::VARCHAR, 2, '0') || ':00' AS clock
    FROM (SELECT o_orderkey, o_orderkey % 26 AS h, o_custkey % 2 AS a, o_orderkey % 3 // 2 AS b, o_custkey % 5 // 4 AS c, 0 AS e FROM orders)""")
def time_bands(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    h = k % 26
    profile = T.victim_profile(c % 2, F.floor(k % 3 / 2), F.floor(c % 5 / 4), F.lit(0))
    return table(spark, d, "orders").select("o_orderkey", T.time_band(h).alias("band"), F.array_join(profile, " ").alias("victims"), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00")).alias("clock"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, to_json({'k': CAST(json_extract_string(props, '$.k') AS BIGINT), 't': event_type})::VARCHAR AS again, CAST(substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 12, 2) AS BIGINT) AS hour FROM events")
def json_and_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    again = F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t")))
    return rows.select("event_id", "p.k", again.alias("again"), F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 12, 2).cast("long").alias("hour"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS x, b.v AS y FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id)
    SELECT a, b, floor(list_cosine_similarity(x[1:32], y[1:32]) * 1e6 + 0.5) / 1e6 AS sections, floor(list_cosine_similarity(x[33:44], y[33:44]) * 1e6 + 0.5) / 1e6 AS premise, floor(list_cosine_similarity(x[57:64], y[57:64]) * 1e6 + 0.5) / 1e6 AS weapon FROM p""")
def cosine_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    b = rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    pairs = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, F.col("a") + 1 == F.col("b"))
    cut = lambda i, j: S.half_up(S.cosine(F.col("x"), F.col("y"), i, j), 6)
    return pairs.select("a", "b", cut(0, 32).alias("sections"), cut(32, 44).alias("premise"), cut(56, 64).alias("weapon"))


@query("SELECT c_custkey, CASE WHEN t < 500 THEN 'Needs revision' WHEN t < 650 THEN 'Bronze' WHEN t < 790 THEN 'Silver' WHEN t < 900 THEN 'Gold' ELSE 'Commissioner''s Commendation' END AS grade, greatest(0.0, least(1.0, c_acctbal / 5000)) AS part, (c_custkey >> 2) & 7 AS bits FROM (SELECT *, c_custkey % 1000 AS t FROM customer)")
def grades(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", S.grade(F.col("c_custkey") % 1000).alias("grade"), S.clamp01(F.col("c_acctbal") / 5000).alias("part"), F.shiftright("c_custkey", 2).bitwiseAND(7).alias("bits"))


@query("""SELECT s_suppkey, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS BIGINT) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, sha256('row|' || s_suppkey) AS digest
    FROM (SELECT s_suppkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('abc|' || s_suppkey)) AS h FROM supplier)""")
def row_identity(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select("s_suppkey", H.uuid5(F.concat(F.lit("abc|"), key)).alias("id"), F.sha2(F.concat(F.lit("row|"), key), 256).alias("digest"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(least(hh, 23)::VARCHAR, 2, '0') || ':' || lpad(least(mi, 59)::VARCHAR, 2, '0') || ':00+05:30' AS occurred_at, CAST(floor(date_diff('day', DATE '1995-01-02', o_orderdate::DATE) / 7 + 0.5) AS BIGINT) AS week_number, o_orderstatus AS tail
    FROM (SELECT *, o_custkey * 37 % 2600 // 100 AS hh, o_custkey * 37 % 2600 % 100 AS mi FROM orders)""")
def donor_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as donors write them: a day in words and a clock without leading zeros."""
    day, clock = F.date_format("o_orderdate", "yyyy MMM dd 00:00"), (F.col("o_custkey") * 37 % 2600).cast("string")
    first = F.lit("1995-01-02").cast("date")
    tail = S.path_tail(F.concat_ws("::", "o_orderpriority", "o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", S.donor_timestamp(day, clock).alias("occurred_at"), S.week_index(F.to_date("o_orderdate"), first).alias("week_number"), tail.alias("tail"))


def _slot(stage: str, block: tuple[int, int]) -> str:
    return f"lambda w: {block[0]} + CAST(CAST('0x' || substr({_hmac(f"'1|{stage}|' || w || '|{signatures.LAYOUT}'")}, 1, 16) AS UBIGINT) % {block[1]} AS BIGINT)"


_ARMS_SQL = "[" + ", ".join(f"'{a}'" for a in _ARMS) + f"][p_partkey % {len(_ARMS)} + 1] || ' ' || p_name"
_OF = lambda labels, first: "list_transform({}, lambda x: " + f"list_position([{', '.join(f"'{x}'" for x in labels)}], x) - 1 + {first})"


@query(
    f"""WITH p AS (SELECT *, upper(replace(p_brand, '#', '')) AS b, p_partkey % 26 AS h, p_partkey % 2 AS m, p_partkey % 3 // 2 AS f, p_partkey % 5 // 4 AS y, upper({_ARMS_SQL}) AS arms FROM part),
    t AS (SELECT *, list_distinct([upper(p_type) || ' ACT::' || (p_size + 1), b || ' CODE::' || (p_size + 2) || 'A', b || ' CODE::' || (p_size + 3)]) AS s FROM p),
    v AS (SELECT x FROM (SELECT unnest(s) AS x FROM t) GROUP BY x ORDER BY count(*) DESC, x LIMIT {signatures.TOP}), k AS (SELECT list(x) AS known FROM v),
    a AS (SELECT p_partkey, list_transform(list_filter(s, lambda x: list_contains(known, x)), {_slot("mo_section_feature", signatures.SECTIONS)}) AS a,
      list_transform(list_distinct(list_filter(string_split_regex(upper(p_name || ' ' || p_type), '[^A-Z]+'), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in T.PLACE_STOP_WORDS)}))), {_slot("mo_premise_feature", signatures.PREMISE)}) AS b,
      CASE WHEN h < 24 THEN [{signatures.TIME} + h // 4] ELSE [] END AS c,
      {_OF(signatures.VICTIMS, signatures.VICTIM).format("list_filter([CASE WHEN m > 0 THEN 'male' END, CASE WHEN f > 0 THEN 'female' END, CASE WHEN y > 0 THEN 'boy' END, CASE WHEN m + f + y > 1 THEN 'multiple' END, CASE WHEN m + f + y = 0 THEN 'none' END], lambda x: x IS NOT NULL)")} AS d,
      list_filter([{", ".join(f"CASE WHEN regexp_matches(arms, '\\b(?:{w})\\b') THEN {signatures.WEAPON + i} END" for i, w in enumerate(T.WEAPONS.values()))}], lambda x: x IS NOT NULL) AS w, arms FROM t, k)
    SELECT p_partkey, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN list_contains(a, i) OR list_contains(b, i) OR list_contains(c, i) OR list_contains(d, i) OR list_contains(w, i)
      OR (i = 63 AND len(w) = 0 AND regexp_matches(arms, '\\b(?:{T.OTHER_WEAPON})\\b')) THEN 1 ELSE 0 END), '') AS bits FROM a"""
)
def mo_signatures(spark: SparkSession, d: str) -> DataFrame:
    """All five blocks of a signature; sections count if they are among the two hundred commonest."""
    store, k = Store(spark), F.col("p_partkey")
    brand, size = F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.col("p_size")
    said = F.concat(F.lower("p_type"), F.lit("  Act U/s: "), (size + 1).cast("string"), F.lit(" "), brand, F.lit(" CODE u/s:"), (size + 2).cast("string"), F.lit("a , "), (size + 3).cast("string"), F.lit(",?!"))
    arms = F.concat(F.element_at(F.array(*map(F.lit, _ARMS)), (k % len(_ARMS) + 1).cast("int")), F.lit(" "), "p_name")
    rows = table(spark, d, "part").select("p_partkey", T.section_tokens(T.sections(said)).alias("sections"), T.premise_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("places"), T.time_band(k % 26).alias("band"), T.victim_profile(k % 2, F.floor(k % 3 / 2), F.floor(k % 5 / 4), F.lit(0)).alias("victims"), T.weapons(arms).alias("weapons"))
    rows = store.cut(rows, "parsed")
    known = signatures.vocabulary(rows, F.col("sections")).agg(F.collect_list("token").alias("known"))
    rows = rows.withColumn("known", known.scalar())
    found = signatures.slots(F.col("sections"), F.col("known"), F.col("places"), F.col("band"), F.col("victims"), F.col("weapons"))
    rows = store.cut(rows.select("p_partkey", found.alias("slots")), "slots")  # written, so that each slot is hashed once
    bits = F.array_join(F.transform(signatures.vector(F.col("slots")), lambda x: x.cast("int").cast("string")), "")
    out = store.cut(rows.select("p_partkey", bits.alias("bits")), "signatures")
    store.close(out)
    return out
