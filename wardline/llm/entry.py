"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    chat_events,
    late_sessions,
    partenum_join,
    pii_feistel,
    positional_index,
    prefix_trie,
    quality_divergence,
    secret_ledger,
    source_mixing,
    sp_viterbi,
    subspace_dedup,
    toxicity_ssk,
    warc_archive,
)
from wardline.llm.common import table
from wardline.sources.scratch import tidy

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secrets(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.link(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archived(table(spark, sf_dir, "pages"))


#: The key of the registered query, known to all: a corpus needs one of its own.
KEY = "key of the registered query"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_divergence.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity_ssk.fit(toxicity_ssk.training(docs, table(spark, sf_dir, "labels")))
    return toxicity_ssk.score(docs, machine)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The model file that sp_viterbi reads, unless the caller names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return sp_viterbi.digests(table(spark, sf_dir, "documents"), model_path)


#: Conversation -1 says the template's own control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    log = chat_events.streamed(rows.unionByName(probe))
    return chat_events.digest(chat_events.render(chat_events.fold(log)))


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sessions.versions(late_sessions.events_of(table(spark, sf_dir, "conversations")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


_ALL = (op1_secret_scans, op2_ngram_jaccard, op3_warc, op4_pii, op5_embedding_dedup, op6_quality_rules, op7_toxicity, op8_mixing, op9_sentencepiece, op10_chat, op11_late_sessions, op12_decontamination, op13_prefix_trie)
QUERIES: dict[str, Query] = {f.__name__: tidy(f) for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
        reach AS (
          SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links
          UNION SELECT r.u, CASE WHEN l.a = r.v THEN l.b ELSE l.a END FROM reach r JOIN links l ON l.a = r.v OR l.b = r.v
        )"""


def _spans(kind: str, pattern: str, whole: str, group: int, least: int) -> str:
    """Spans of a pattern: the pieces between its matches say where these lie."""
    return f"""
          SELECT doc_id, '{kind}' AS kind, start, start + length(m) AS stop FROM (
            SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g,
              unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS start
            FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{whole}', {group}) AS gs, string_split_regex(t, '{pattern}') AS pieces FROM d)
          ) WHERE length(g) >= {least}"""


_WORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"(?:{_WORD})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_KINDS = (
    ("assign", _ASSIGN, 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
)



def _crc(said: str) -> str:
    """CRC-32 of a text of digits, bit by bit."""
    bit = "list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, z: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)"
    codes = f"list_transform(range(1, length({said}) + 1), lambda i: unicode(substr({said}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: {bit}), 4294967295)"


_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    "op1_secret_scans": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({" UNION ALL ".join(_spans(kind, pattern, pattern, group, least) for kind, pattern, group, least in _KINDS)}),
        o AS (SELECT *, list_position([{", ".join(f"'{k[0]}'" for k in _KINDS)}], kind) AS k, kind || ':' || start || ':' || stop AS said FROM s)
        SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
          sha256(coalesce(string_agg(said, ',' ORDER BY start, k) FILTER (WHERE k <= 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start, k), '') AS spans
        FROM d LEFT JOIN o USING (doc_id) GROUP BY doc_id
    """,
    "op2_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
        ), n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, hash(unnest(s)) AS x FROM s),
        k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),{_REACH}
        SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(v) FROM reach WHERE u = doc_id), doc_id)) AS component_id FROM n
    """,
    "op5_embedding_dedup": f"""
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.label = q.label AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.98),{_REACH},
        m AS (SELECT u, min(v) AS v FROM reach GROUP BY u), d AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM links UNION ALL SELECT b FROM links) GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m.v, vec_id)) AS component_id, least(vec_id, coalesce(m.v, vec_id)) = vec_id AS kept
        FROM e LEFT JOIN m ON u = vec_id LEFT JOIN d ON x = vec_id
    """,
    "op6_quality_rules": quality_divergence.sql(),
    "op8_mixing": """
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, sha256(coalesce(doc_id::VARCHAR, '') || '|' || length(coalesce(source, '')) || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS key FROM documents
        ), n AS (SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][CAST((place - 1) % 3 AS INT) + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM s),
        r AS (
          SELECT *, row_number() OVER o AS rank,
            (sum(source_size) OVER () * 1.5::DOUBLE - (sum(most) OVER (o ROWS UNBOUNDED PRECEDING) - most)) / (sum(w) OVER () - sum(w) OVER (o ROWS UNBOUNDED PRECEDING) + w) AS level
          FROM w WINDOW o AS (ORDER BY most / w, place)
        ), f AS (SELECT min(rank) AS rank, arg_min(level, rank) AS level FROM r WHERE level * w <= most),
        t AS (SELECT source, source_size, CASE WHEN f.rank IS NULL OR r.rank < f.rank THEN most ELSE least(most, f.level * w) END AS target FROM r, f),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
        SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(sha256('20240:' || key || ':' || number), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source
    """,
    "op3_warc": """
        WITH p AS (
          SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), d AS (
          SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, sha256(body) AS k FROM p
        ), m AS (
          SELECT *, max(page_id) OVER (PARTITION BY k) AS f FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id <> f THEN f END AS refers_to
        FROM m
    """,
    "op11_late_sessions": f"""
        WITH k AS (SELECT conv_id::VARCHAR AS k, conv_id || ':' || turn AS kt, conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        c AS (SELECT conv_id, turn, {_crc("k")} AS c, {_crc("kt")} AS h FROM k),
        s AS (SELECT 2 * CAST(floor(conv_id / 8) AS BIGINT) + c % 2 AS u, c // 2 % 7200 + 300 * turn + h % 600 AS t, h FROM c),
        e AS (SELECT u, t, h, CAST(floor(t / 1800) AS BIGINT) + CASE WHEN h // 600 % 5 = 0 THEN h // 600 % 4 ELSE 0 END AS batch FROM s),
        p AS (SELECT DISTINCT u, batch AS b FROM e),
        f AS (SELECT e.*, b, CASE WHEN t - lag(t) OVER (PARTITION BY u, b ORDER BY t) <= 240 THEN 0 ELSE 1 END AS fresh FROM p JOIN e USING (u) WHERE batch <= b),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY u, b ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f),
        v AS (SELECT u, b, min(t) AS s, max(t) AS e, count(*) AS n, count(*) FILTER (WHERE batch = b) AS n_new, CAST(sum(h) AS BIGINT) AS h FROM i GROUP BY u, b, k HAVING count(*) FILTER (WHERE batch = b) > 0),
        r AS (SELECT v.*, min(w.b) AS rb, arg_min(w.s, w.b) AS rs FROM v LEFT JOIN v w ON w.u = v.u AND w.b > v.b AND w.s <= v.s AND w.e >= v.e GROUP BY ALL),
        x AS (SELECT u, rb, rs, count(*) AS n FROM r WHERE rb IS NOT NULL GROUP BY ALL)
        SELECT r.u AS "user", b AS batch, s AS start_s, e AS end_s, r.n AS n_events, n_new, coalesce(x.n, 0) AS n_retracted, h AS h_sum, r.rb AS retracted_batch, r.rs AS retracted_start_s
        FROM r LEFT JOIN x ON x.u = r.u AND x.rb = b AND x.rs = s
    """,
    "op12_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
        v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v))),
        f AS (SELECT r, i, n, item_id FROM g JOIN v USING (n, x)),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM f) GROUP BY r),
        m AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM f) GROUP BY r),
        o AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS n FROM o GROUP BY x),
        y AS (SELECT DISTINCT k, item_id, x FROM (SELECT row_number() OVER () AS k, item_id, w FROM b), unnest(w) t(x)),
        q AS (SELECT *, count(*) OVER (PARTITION BY k) AS n_all, min(n) OVER (PARTITION BY k) AS least
          FROM (SELECT k, item_id, x, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), x) AS place FROM y LEFT JOIN c USING (x)) WHERE place <= 3),
        z AS (SELECT o.r, o.p, q.* FROM o JOIN q USING (x) WHERE least > 0),
        s AS (SELECT a.r, a.item_id FROM z a LEFT JOIN z b ON b.r = a.r AND b.k = a.k AND b.place > 1 AND abs(b.p - a.p) < 20 WHERE a.place = 1 GROUP BY a.r, a.p, a.k, a.item_id, a.n_all HAVING count(DISTINCT b.place) = a.n_all - 1),
        e AS (SELECT r, count(DISTINCT item_id) AS n_near FROM s GROUP BY r)
        SELECT doc_id, len(coalesce(w, [])) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r) LEFT JOIN e USING (r)
    """,
    "op13_prefix_trie": f"""
        WITH o AS (
          SELECT conv_id AS c, conv_id::VARCHAR AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL
        ), m AS (SELECT c, c - c % 5 AS base, {_crc("k")} % 9 AS h FROM (SELECT DISTINCT c, k FROM o)),
        t AS (SELECT m.c, o.i, role, text FROM m JOIN o ON o.c = base AND o.i <= h UNION ALL SELECT c, o.i, role, text FROM m JOIN o USING (c) WHERE o.i > h),
        p AS (
          SELECT c, row_number() OVER w AS d, octet_length(encode(text)) AS bytes, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS x FROM t WINDOW w AS (PARTITION BY c ORDER BY i)
          UNION ALL SELECT c, 0, 0, '' FROM m
        ), n AS (SELECT x, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM p GROUP BY x),
        e AS (SELECT DISTINCT a.x, b.x AS up FROM p a JOIN p b ON a.c = b.c AND b.d = a.d - 1),
        l AS (SELECT up AS x, count(*) AS n FROM e GROUP BY up),
        q AS (SELECT DISTINCT a.x AS up, b.x FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d),
        z AS (SELECT up AS x, count(*) FILTER (WHERE l.n IS NULL) AS leaves, CAST(sum((n.n - 1) * bytes) AS BIGINT) AS saved FROM q JOIN n USING (x) LEFT JOIN l USING (x) GROUP BY up),
        y AS (SELECT x, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM (SELECT c, arg_max(x, d) AS x FROM p GROUP BY c) GROUP BY x)
        SELECT n.c AS conv_id, n.d AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(l.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(y.s, sha256('')) AS ends_sha256
        FROM n LEFT JOIN e USING (x) LEFT JOIN n u ON u.x = e.up LEFT JOIN l ON l.x = n.x JOIN z ON z.x = n.x LEFT JOIN y ON y.x = n.x
    """,
    "op10_chat": """
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        ), e AS (
          SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS t,
            replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\.') AS r FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(12 + length(r) + 1 + length(t) + 11) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
}
