"""Queries over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.model import Policy
from .functions.rules import BUILT_IN, CONTAINED, KEYWORDS, MERGE, Detection, Rule, boosted
from .operators import detect as det
from .operators import mask as msk
from .operators import session as ses
from .operators.json_mask import mask_free, mask_typed
from .sources import store
from .sources.scan import spread

# ---- texts: documents with findings of every type added by row id, the same SQL for both engines -----------------------------
CARDS = ("4111111111111111", "5555555555554444", "378282246310005", "6011111111111117")
IBANS = ("GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606", "NL91ABNA0417164300")
_case = lambda key, vals: "CASE " + " ".join(f"WHEN {key} % {len(vals)} = {i} THEN '{v}'" for i, v in enumerate(vals)) + " END"


def planted_sql(key: str, text: str, sha) -> str:
    """An expression: the text, and after it findings by `key % 13`."""
    k = f"({key})"
    pad = lambda e, n: f"lpad(CAST({e} AS {{S}}), {n}, '0')"
    parts = [
        f"' mail user' || CAST({k} AS {{S}}) || '@mail.example.org now'", f"' call 555-' || {pad(f'{k} % 900 + 100', 3)} || '-' || {pad(f'{k} % 9000 + 1000', 4)} || ' now'",
        f"' number ' || {pad(f'100 + {k} % 500', 3)} || '-' || {pad(f'10 + {k} % 80', 2)} || '-' || {pad(f'1000 + {k} % 9000', 4)} || ' now'", f"' SSN ' || {pad(f'100000000 + {k} % 400000000', 9)} || ' now'",
        f"' card ' || {_case(k, CARDS)} || ' now'", f"' host 10.' || CAST({k} % 256 AS {{S}}) || '.0.7 now'",
        f"' host ' || repeat({pad(f'{k} % 10000', 4)} || ':', 7) || 'beef now'", f"' AKIA' || upper(substr({sha(k)}, 1, 16)) || ' now'", f"' ghp_' || substr({sha(k)}, 1, 36) || ' now'",
        f"' api_token = \"' || substr({sha(k)}, 1, 32) || '\" now'", f"' eyJ' || substr({sha(k)}, 1, 12) || '.' || substr({sha(k)}, 13, 12) || '.' || substr({sha(k)}, 25, 12) || ' now'",
        f"' pay ' || {_case(k, IBANS)} || ' now'", f"' at ' || CAST({k} % 900 + 100 AS {{S}}) || ' Maple Street now'",
    ]
    return f"{text} || CASE " + " ".join(f"WHEN {k} % 13 = {i} THEN {p}" for i, p in enumerate(parts)) + " ELSE '' END"


_SPARK = planted_sql("doc_id", "text", lambda k: f"sha2(CAST({k} AS STRING), 256)").replace("{S}", "STRING")
_DUCK = planted_sql("doc_id", "text", lambda k: f"sha256(CAST({k} AS VARCHAR))").replace("{S}", "VARCHAR")


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_read(spark, sf, "documents").select("doc_id", "lang", "source", "text")).selectExpr("doc_id", "lang", "source", f"{_SPARK} AS text")


TEXTS = f"texts AS (SELECT doc_id, lang, source, {_DUCK} AS text FROM documents)"

# ---- one rule --------------------------------------------------------------------------------------------------------------------
NAMES = ("email", "phone", "ssn_dashed", "ssn_plain", "credit_card", "ipv4", "ipv6", "aws_key", "api_key", "api_assignment", "jwt", "iban", "address")


def rule_query(i: int):
    rule = BUILT_IN[i]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = Detection(rules=(rule,), keywords={}, threshold=0.0)
        s = det.each(texts(spark, sf), det.candidates(F.col("text"), d))
        return s.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("value"))

    return run


W, S = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x{85}\p{Z}"
_oct = r"(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}\p{Nd}|[1-9]?\p{Nd})"
#: For each rule in RE2's terms: the match, what may follow it, what a character before must be, and a filter of documents.
#: before: "b" a word border, "d" no digit.
RE2 = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", f"[^{W}]", "b", "@"),
    "phone": (rf"(?:\+?\p{{Nd}}{{1,3}}[-.{S}]?)?\(?\p{{Nd}}{{3}}\)?[-.{S}]\p{{Nd}}{{3}}[-.{S}]\p{{Nd}}{{4}}", r"\P{Nd}", "d", rf"\p{{Nd}}{{3}}[-.{S}]\p{{Nd}}{{4}}"),
    "ssn_dashed": (r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}", r"\P{Nd}", "d", r"-\p{Nd}{2}-"),
    "ssn_plain": (r"\p{Nd}{9}", r"\P{Nd}", "d", r"\p{Nd}{9}"),
    "credit_card": (r"\p{Nd}(?:[ -]?\p{Nd}){12,18}", r"\P{Nd}", "d", r"\p{Nd}(?:[ -]?\p{Nd}){12}"),
    "ipv4": (rf"(?:{_oct}\.){{3}}{_oct}", f"[^{W}]", "b", r"\p{Nd}\.\p{Nd}"),
    "ipv6": (r"(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}", f"[^{W}]", "b", ":"),
    "aws_key": (r"(?:AKIA|ASIA)[0-9A-Z]{16}", f"[^{W}]", "b", "A[KS]IA"),
    "api_key": (r"(?:sk-[A-Za-z0-9_-]{19,}[A-Za-z0-9_]|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{9,}[A-Za-z0-9]|AIza[A-Za-z0-9_-]{34}[A-Za-z0-9_])", f"[^{W}]", "b", "sk-|gh[pousr]_|xox|AIza"),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*[A-Za-z0-9_]", f"[^{W}]", "b", "eyJ"),
    "iban": (r"[A-Z]{2}\p{Nd}{2}[A-Z0-9]{11,30}", f"[^{W}]", "b", r"[A-Z]{2}\p{Nd}{2}"),
}
#: The two whose finding is not the whole match, or whose end depends on what follows: (parts before the finding, its parts and
#: what follows, a filter of documents); the finding is parts 2 to 4 put together.
_kinds = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Ter"
PARTS = {
    "api_assignment": (rf"(?i)^([{W}]{{0,40}}(?:key|secret|token|password|credential)[{W}]{{0,40}}[{S}]*[:=][{S}]*[\x27\x22]?)([A-Za-z0-9_\-/+]{{16,}})()()([\x27\x22]?)", "(?i)(?:key|secret|token|password|credential)"),
    "address": (rf"^()(\p{{Nd}}{{1,6}}[{S}]+(?:[A-Z][a-zA-Z]*[{S}]){{1,4}}(?:{_kinds}))(?:(\.)[{W}]|(,?[{S}]+(?:Apt|Suite|Ste|Unit)\.?[{S}]*#?[{W}]+)|[^{W}]|$)()", rf"\p{{Nd}}[{S}]+[A-Z]"),
}
VALID = {
    "ssn_dashed": "substr(value, 1, 3) NOT IN ('000', '666') AND value[1] <> '9'", "ssn_plain": "substr(value, 1, 3) NOT IN ('000', '666') AND value[1] <> '9'",
    "credit_card": "list_sum(list_transform(range(length(regexp_replace(value, '[ -]', '', 'g'))), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse(regexp_replace(value, '[ -]', '', 'g'))[i + 1] AS INT) ELSE CAST(reverse(regexp_replace(value, '[ -]', '', 'g'))[i + 1] AS INT) * 2 - CASE WHEN CAST(reverse(regexp_replace(value, '[ -]', '', 'g'))[i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    "iban": "list_reduce(list_transform(range(length(value)), lambda i: (substr(value, 5) || substr(value, 1, 4))[i + 1]), lambda a, c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN (CAST(a AS BIGINT) * 10 + ascii(c) - 48) % 97 ELSE (CAST(a AS BIGINT) * 100 + ascii(c) - 55) % 97 END AS VARCHAR), '0') = '1'",
}


def rule_ctes(name: str, source: str = "texts") -> str:
    """CTEs that end in f_<name>(doc_id, start, end, value): leftmost non-overlapping matches by anchored matching at
    every place, then a fold that drops what overlaps the match before."""
    if name in PARTS:
        rx, has = PARTS[name]
        return f"""
p_{name} AS (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM {source} WHERE regexp_matches(text, '{has}')),
c_{name} AS (SELECT doc_id, i, regexp_extract(substr(text, i, 4000), '{rx}', ['a', 'b', 'c', 'd', 'e']) AS x FROM p_{name} WHERE regexp_matches(CASE WHEN i = 1 THEN '' ELSE substr(text, i - 1, 1) END, '[{W}]') <> regexp_matches(substr(text, i, 1), '[{W}]')),
l_{name} AS (SELECT doc_id, list({{'a': i, 'b': i + length(x.a || x.b || x.c || x.d || x.e), 'at': length(x.a), 'v': x.b || x.c || x.d}} ORDER BY i) AS c FROM c_{name} WHERE x.b <> '' GROUP BY doc_id),
k_{name} AS (SELECT doc_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN x[1].a >= acc[-1].b THEN list_concat(acc, x) ELSE acc END)) AS k FROM l_{name}),
f_{name} AS (SELECT doc_id, CAST(k.a - 1 + k.at AS INTEGER) AS start, CAST(k.a - 1 + k.at + length(k.v) AS INTEGER) AS "end", k.v AS value FROM k_{name})"""
    rx, after, before, has = (x.replace("'", "''") if isinstance(x, str) else x for x in RE2[name])
    cur, prev = "substr(text, i, 1)", "CASE WHEN i = 1 THEN '' ELSE substr(text, i - 1, 1) END"
    border = f"NOT regexp_matches({prev}, '\\p{{Nd}}')" if before == "d" else f"regexp_matches({prev}, '[{W}]') <> regexp_matches({cur}, '[{W}]')"
    return f"""
p_{name} AS (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM {source} WHERE regexp_matches(text, '{has}')),
c_{name} AS (SELECT doc_id, i, regexp_extract(substr(text, i, 400), '^({rx})(?:{after}|$)', 1) AS v FROM p_{name} WHERE {border}),
l_{name} AS (SELECT doc_id, list({{'a': i, 'b': i + length(v), 'v': v}} ORDER BY i) AS c FROM c_{name} WHERE v <> '' GROUP BY doc_id),
k_{name} AS (SELECT doc_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN x[1].a >= acc[-1].b THEN list_concat(acc, x) ELSE acc END)) AS k FROM l_{name}),
f_{name} AS (SELECT * FROM (SELECT doc_id, CAST(k.a - 1 AS INTEGER) AS start, CAST(k.b - 1 AS INTEGER) AS "end", k.v AS value FROM k_{name}) WHERE {VALID.get(name, 'true')})"""


# ---- resolution over made-up pools ---------------------------------------------------------------------------------------------
def pools(spark: SparkSession, sf: str) -> DataFrame:
    """A few spans a row from its id, types A and B, over a text of digits; the same numbers in SQL."""
    spans = ", ".join(
        f"struct(CAST((doc_id * {m} + {i}) % 50 AS INT) AS start, CAST((doc_id * {m} + {i}) % 50 + 1 + (doc_id + {i}) % 9 AS INT) AS end, IF((doc_id + {i}) % 3 = 0, 'B', 'A') AS entity_type, CAST(50 + (doc_id * {m + 2}) % 50 AS DOUBLE) / 100 AS score, 'r{i}' AS recognizer, '' AS text, (doc_id + {i}) % 4 = 0 AS validated, CAST(array() AS ARRAY<STRING>) AS explanation, {i} AS ordinal)"
        for i, m in enumerate((7, 11, 13, 17, 19))
    )
    return _read(spark, sf, "documents").selectExpr("doc_id", "repeat('0123456789', 6) AS text", f"array({spans}) AS spans")


def resolved(spark: SparkSession, sf: str, d: Detection) -> DataFrame:
    p = pools(spark, sf)
    r = det.each(p, det.resolve(F.col("spans"), F.col("text"), d))
    return r.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in ("start", "end", "entity_type", "score", "recognizer", "validated")])


_POOL = "pool AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ordinal, CAST((doc_id * {m} + {i}) % 50 AS INTEGER) AS s, CAST((doc_id * {m} + {i}) % 50 + 1 + (doc_id + {i}) % 9 AS INTEGER) AS e, CASE WHEN (doc_id + {i}) % 3 = 0 THEN 'B' ELSE 'A' END AS t, CAST(50 + (doc_id * {m + 2}) % 50 AS DOUBLE) / 100 AS score, 'r{i}' AS recognizer, (doc_id + {i}) % 4 = 0 AS validated FROM documents"
    for i, m in enumerate((7, 11, 13, 17, 19))
) + ")"
RESOLVED_SQL = f"""WITH {_POOL},
l AS (SELECT doc_id, list({{'s': s, 'e': e, 't': t, 'score': score, 'r': recognizer, 'v': validated}} ORDER BY validated DESC, score DESC, e - s DESC, s, ordinal) AS c FROM pool GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM l)
SELECT doc_id, k.s AS start, k.e AS "end", k.t AS entity_type, k.score AS score, k.r AS recognizer, k.v AS validated FROM k"""
CONTAINED_SQL = RESOLVED_SQL.replace(
    "CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END",
    "CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e AND NOT (((x[1].s <= y.s AND y.e <= x[1].e) OR (y.s <= x[1].s AND x[1].e <= y.e)) AND ((x[1].v AND NOT y.v) OR (x[1].v = y.v AND x[1].e - x[1].s < y.e - y.s))))) > 0 THEN acc ELSE list_concat(list_filter(acc, lambda y: NOT (y.s < x[1].e AND x[1].s < y.e)), x) END",
)

MERGED_SQL = (
    RESOLVED_SQL.replace("SELECT doc_id, k.s AS start", "SELECT doc_id, k FROM k) SELECT doc_id, k.s AS start", 1).replace("k AS (SELECT doc_id, unnest(list_reduce", "r AS (SELECT doc_id, unnest(list_reduce", 1).replace("AS k FROM l)\nSELECT doc_id, k FROM k)", """AS k FROM l),
o AS (SELECT doc_id, list(k ORDER BY k.s) AS c FROM r GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN acc[-1].e = x[1].s AND acc[-1].t = x[1].t
  THEN list_concat(acc[:-2], [{'s': acc[-1].s, 'e': x[1].e, 't': x[1].t, 'score': greatest(acc[-1].score, x[1].score), 'r': 'merged(' || acc[-1].r || '+' || x[1].r || ')', 'v': acc[-1].v OR x[1].v}])
  ELSE list_concat(acc, x) END)) AS k FROM o)""")
)  # the pools' texts are digits, so only spans that touch merge


# ---- all rules -------------------------------------------------------------------------------------------------------------------
def _scored(source: str = TEXTS) -> str:
    """CTEs that end in cand(doc_id, start, end, entity_type, score, validated, ordinal, value): every rule's findings."""
    each = []
    for i, (name, rule) in enumerate(zip(NAMES, BUILT_IN)):
        words, plain = KEYWORDS.get(rule.entity, ()), f"{round(rule.score, 2)}::DOUBLE"
        near = "lower(substr(text, greatest(start - 40, 0) + 1, least(start, 40)) || ' ' || substr(text, \"end\" + 1, 40))"
        score = f"CASE WHEN {' OR '.join(f'contains({near}, {chr(39)}{w}{chr(39)})' for w in words)} THEN {boosted(rule.score)}::DOUBLE ELSE {plain} END" if words else plain
        each.append(f"SELECT doc_id, start, \"end\", '{rule.entity}' AS entity_type, {score} AS score, {'true' if rule.validator else 'false'} AS validated, {i} AS ordinal, value FROM f_{name} JOIN texts USING (doc_id)")
    return f"{source}, " + ", ".join(rule_ctes(n) for n in NAMES) + ", cand AS (" + " UNION ALL ".join(each) + ")"


def _found(where: str, source: str = TEXTS) -> str:
    """CTEs that end in found: the strict choice among the candidates that pass `where`."""
    return f"""{_scored(source)},
cl AS (SELECT doc_id, list({{'s': start, 'e': "end", 't': entity_type, 'score': score, 'v': validated, 'x': value}} ORDER BY validated DESC, score DESC, "end" - start DESC, start, ordinal) AS c FROM cand WHERE {where} GROUP BY doc_id),
ck AS (SELECT doc_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM cl),
found AS (SELECT doc_id, k.s AS start, k.e AS "end", k.t AS entity_type, k.score AS score, k.v AS validated, k.x AS value FROM ck)"""


def _found_sql(where: str) -> str:
    return f'WITH {_found(where)} SELECT doc_id, start, "end", entity_type, score, validated FROM found'


def _found_masked(put: str) -> str:
    """CTEs that end in masked(doc_id, masked_text, n_tokens): each finding put in place; `put` is over entity_type, value and n."""
    return f"""{_found('score >= 0.5')},
firsts AS (SELECT doc_id, entity_type, value, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY min(start)) AS n FROM found GROUP BY doc_id, entity_type, value),
pieces AS (SELECT doc_id, start, "end", {put} AS put FROM found JOIN firsts USING (doc_id, entity_type, value)),
seq AS (SELECT doc_id, start, "end", put, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS frm, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) = 1 AS last FROM pieces),
built AS (SELECT s.doc_id, string_agg(substr(t.text, frm + 1, start - frm) || put || CASE WHEN last THEN substr(t.text, "end" + 1) ELSE '' END, '' ORDER BY start) AS masked_text FROM seq s JOIN texts t USING (doc_id) GROUP BY s.doc_id),
masked AS (SELECT t.doc_id, coalesce(b.masked_text, t.text) AS masked_text, CAST(coalesce((SELECT count(*) FROM firsts f WHERE f.doc_id = t.doc_id), 0) AS INTEGER) AS n_tokens FROM texts t LEFT JOIN built b USING (doc_id))"""


# ---- masking ---------------------------------------------------------------------------------------------------------------------
KEY = bytes(range(32))
MIXED = Policy("replace", (("EMAIL", "redact"), ("PHONE", "mask"), ("IP_ADDRESS", "hash")), hash_key=KEY)
EMAIL_ONLY = Detection(rules=BUILT_IN[:1], keywords={}, threshold=0.0)


def masked(d: Detection, p: Policy):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return msk.mask(texts(spark, sf), "text", d, p).select("doc_id", "masked_text")

    return run


def _email_masked(put: str) -> str:
    """DuckDB: each finding of f_email put in place, from the right; `put` is an expression over value and n."""
    return f"""WITH {TEXTS}, {rule_ctes('email')},
firsts AS (SELECT doc_id, value, dense_rank() OVER (PARTITION BY doc_id ORDER BY min(start)) AS n FROM f_email GROUP BY doc_id, value),
pieces AS (SELECT doc_id, start, "end", {put} AS put FROM f_email JOIN firsts USING (doc_id, value)),
seq AS (SELECT doc_id, start, "end", put, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS frm, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) = 1 AS last FROM pieces),
built AS (SELECT s.doc_id, string_agg(substr(t.text, frm + 1, start - frm) || put || CASE WHEN last THEN substr(t.text, "end" + 1) ELSE '' END, '' ORDER BY start) AS masked_text FROM seq s JOIN texts t USING (doc_id) GROUP BY s.doc_id)
SELECT t.doc_id, coalesce(b.masked_text, t.text) AS masked_text FROM texts t LEFT JOIN built b USING (doc_id)"""


def roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    m = msk.mask(texts(spark, sf).withColumn("text", F.concat("text", F.lit(" <EMAIL_1> 😀"))), "text", p=Policy("surrogate"))
    return m.select("doc_id", msk.unmask(F.col("masked_text"), F.col("mapping")).alias("text"))


def guarded(spark: SparkSession, sf: str) -> DataFrame:
    """All texts, with a lookalike of the first token: whether the token avoided it and the text came back."""
    t = texts(spark, sf).withColumn("text", F.concat("text", F.lit(" <EMAIL_1>")))
    m = msk.mask(t, "text", EMAIL_ONLY)
    return m.select("doc_id", F.size("mapping").alias("n"), (~F.exists("mapping", lambda e: e["token"] == "<EMAIL_1>")).alias("avoided"), (msk.unmask(F.col("masked_text"), F.col("mapping")) == F.col("text")).alias("restored"))


# ---- sessions --------------------------------------------------------------------------------------------------------------------
_CONV = "conv_id, turn, text || ' mail user' || CAST((conv_id + turn % 3) % 7 AS {S}) || '@mail.example.org and user' || CAST(conv_id % 5 AS {S}) || '@mail.example.org now' AS text"


def talks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_read(spark, sf, "conversations")).selectExpr("conv_id", "turn", _CONV.format(S="STRING").removeprefix("conv_id, turn, "))


def session_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return ses.mapping_table(talks(spark, sf), "conv_id", "turn", "text", EMAIL_ONLY).select(F.col("session_id").alias("conv_id"), "token", "entity_type", "original")


def session_masked(spark: SparkSession, sf: str) -> DataFrame:
    return ses.mask_sessions(talks(spark, sf), "conv_id", "turn", "text", EMAIL_ONLY)[0].select("conv_id", "turn", "masked_text")


def session_back(spark: SparkSession, sf: str) -> DataFrame:
    m, table = ses.mask_sessions(talks(spark, sf), "conv_id", "turn", "text")
    return ses.unmask_sessions(m.select("conv_id", "turn", "masked_text"), table, "conv_id").select("conv_id", "turn", "text")


_TALKS = f"texts AS (SELECT conv_id * 1000 + turn AS doc_id, {_CONV.format(S='VARCHAR')} FROM conversations), {rule_ctes('email')}"
SESSION_SQL = f"""WITH {_TALKS},
firsts AS (SELECT conv_id, value, min(turn * 1000000 + start) AS seen FROM f_email JOIN texts USING (doc_id) GROUP BY conv_id, value)
SELECT conv_id, '<EMAIL_' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seen, value) AS VARCHAR) || '>' AS token, 'EMAIL' AS entity_type, value AS original FROM firsts"""


# ---- JSON ----------------------------------------------------------------------------------------------------------------------------
def json_free(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(_read(spark, sf, "events"))
    j = e.select("event_id", F.to_json(F.struct(F.col("user_id"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.example.org")).alias("mail"), F.lit(4111111111111111).alias("card"), F.col("event_type").alias("kind"))).alias("props"))
    m = mask_free(j, "props")
    return m.select("event_id", F.get_json_object("masked_json", "$.mail").alias("mail"), F.length(F.get_json_object("masked_json", "$.card")).alias("card_digits"), (F.get_json_object("masked_json", "$.card") == "4111111111111111").alias("card_kept"), F.get_json_object("masked_json", "$.kind").alias("kind"), F.get_json_object("masked_json", "$.user_id").cast("long").alias("user_id"))


def json_typed(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(_read(spark, sf, "events").select("event_id", "user_id", "value")).select("event_id", F.struct(F.array(F.concat(F.lit("to user"), F.col("user_id").cast("string"), F.lit("@mail.example.org")), F.lit("none")).alias("mails"), F.struct(F.col("value").alias("v"), F.lit("host 10.0.0.7").alias("host")).alias("in")).alias("p"))
    m = mask_typed(e, "p")
    return m.select("event_id", F.array_join("p.mails", "|").alias("mails"), F.col("p.in.host").alias("host"), F.col("p.in.v").alias("v"))


# ---- reports ---------------------------------------------------------------------------------------------------------------------------
def found(spark: SparkSession, sf: str) -> DataFrame:
    return det.explode_spans(det.detect(texts(spark, sf), "text"))


def encrypted(spark: SparkSession, sf: str) -> DataFrame:
    m = msk.mask(texts(spark, sf), "text", EMAIL_ONLY).select("doc_id", store.encrypt(F.col("mapping"), KEY).alias("blob"))
    return m.select("doc_id", F.explode(store.decrypt(F.col("blob"), KEY)).alias("e")).select("doc_id", F.col("e.token").alias("token"), F.col("e.original").alias("original"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """All rules, resolved and replaced, restored again."""
    m = msk.mask(texts(spark, sf), "text")
    return m.select("doc_id", "masked_text", F.size("mapping").alias("n_tokens"), (msk.unmask(F.col("masked_text"), F.col("mapping")) == F.col("text")).alias("restored"))


def spans_of(d: Detection):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return det.explode_spans(det.detect(texts(spark, sf), "text", d)).select("doc_id", "start", "end", "entity_type", "score", "validated")

    return run


CUSTOM = Detection(rules=(), keywords={}, custom=(Rule("LICENSE_LINE", r"Released under the (\w+) License", 0.8),))
_email = f"WITH {TEXTS}, {rule_ctes('email')} "

QUERIES = {f"q{i + 1:02d}_{n}_spans": rule_query(i) for i, n in enumerate(NAMES)} | {
    "q20_candidates_scored": lambda s, f: det.each(texts(s, f), det.candidates(F.col("text"), Detection(threshold=0.0))).select("doc_id", "s.start", "s.end", "s.entity_type", "s.score", "s.validated"),
    "q21_resolved_strict": lambda s, f: resolved(s, f, Detection(threshold=0.0)),
    "q22_resolved_contained": lambda s, f: resolved(s, f, Detection(threshold=0.0, overlap=CONTAINED)),
    "q23_resolved_merge": lambda s, f: resolved(s, f, Detection(threshold=0.0, overlap=MERGE)),
    "q24_threshold_override": spans_of(Detection(thresholds={"IP_ADDRESS": 0.8, "SSN": 0.3})),
    "q25_disabled": spans_of(Detection(disabled=frozenset({"EMAIL", "IP_ADDRESS"}))),
    "q26_exclusions": spans_of(Detection(rules=BUILT_IN[:1], keywords={}, exclude_values=("user0@mail.example.org",), exclude_patterns=(r"^user1",))),
    "q27_custom_pattern": lambda s, f: det.explode_spans(det.detect(texts(s, f), "text", CUSTOM)).select("doc_id", "start", "end", "value"),
    "q28_all_types": spans_of(Detection()),
    "q30_mask_replace": masked(EMAIL_ONLY, Policy()),
    "q31_redact": masked(EMAIL_ONLY, Policy("redact")),
    "q32_mask_tail": masked(EMAIL_ONLY, Policy("mask")),
    "q33_hash": masked(EMAIL_ONLY, Policy("hash", hash_key=KEY)),
    "q34_mixed": masked(Detection(), MIXED),
    "q35_surrogate": masked(Detection(), Policy("surrogate")),
    "q36_unmask_roundtrip": roundtrip,
    "q37_reserved_guard": guarded,
    "q40_session_tokens": session_tokens,
    "q41_session_mask": session_masked,
    "q42_session_unmask": session_back,
    "q50_json_mask": json_free,
    "q51_json_typed": json_typed,
    "q60_pii_report": lambda s, f: found(s, f).groupBy("lang", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values")),
    "q61_pii_cube": lambda s, f: found(s, f).cube("lang", "source").agg(F.count(F.lit(1)).alias("n")),
    "q62_docs_without_pii": lambda s, f: det.detect(spread(_read(s, f, "documents").select("doc_id", "text"))).where(~F.coalesce(F.size("spans") > 0, F.lit(False))).select("doc_id"),
    "q63_topk_docs": lambda s, f: found(s, f).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(20),
    "q70_mapping_encrypt_roundtrip": encrypted,
    "q90_flagship": flagship,
}

_pad = "unhex('" + bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex() + "')", "unhex('" + bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex() + "')"
_TOKEN = "'<' || entity_type || '_' || CAST(n AS VARCHAR) || '>'"
_TAIL = "reverse(list_reduce(list_transform(string_split(reverse(value), ''), lambda c: c), lambda a, c: a || CASE WHEN regexp_matches(c, '[\\p{L}\\p{N}]') AND length(regexp_replace(a, '[^\\p{L}\\p{N}]', '', 'g')) >= 4 THEN 'X' ELSE c END, ''))"
_all = f"WITH {_found('score >= 0.5')} "
_HASH = f"sha256({_pad[0]} || unhex(sha256({_pad[1]} || encode(value))))"
_MIXED_PUT = f"CASE entity_type WHEN 'EMAIL' THEN '[REDACTED_EMAIL]' WHEN 'PHONE' THEN {_TAIL} WHEN 'IP_ADDRESS' THEN {_HASH} ELSE {_TOKEN} END"
SESSION_MASK_SQL = f"""WITH {_TALKS},
firsts AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn * 1000000 + start), value) AS n FROM f_email JOIN (SELECT DISTINCT doc_id, doc_id // 1000 AS conv_id, doc_id % 1000 AS turn FROM texts) USING (doc_id) GROUP BY conv_id, value),
seq AS (SELECT doc_id, start, "end", '<EMAIL_' || CAST(n AS VARCHAR) || '>' AS put, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS frm, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) = 1 AS last FROM f_email f JOIN firsts s ON f.doc_id // 1000 = s.conv_id AND f.value = s.value),
built AS (SELECT s.doc_id, string_agg(substr(t.text, frm + 1, start - frm) || put || CASE WHEN last THEN substr(t.text, "end" + 1) ELSE '' END, '' ORDER BY start) AS masked_text FROM seq s JOIN texts t USING (doc_id) GROUP BY s.doc_id)
SELECT t.conv_id, t.turn, coalesce(b.masked_text, t.text) AS masked_text FROM texts t LEFT JOIN built b USING (doc_id)"""
SQL = {f"q{NAMES.index(n) + 1:02d}_{n}_spans": f'WITH {TEXTS}, {rule_ctes(n)} SELECT doc_id, start, "end", value FROM f_{n}' for n in NAMES} | {
    "q20_candidates_scored": f'WITH {_scored()} SELECT doc_id, start, "end", entity_type, score, validated FROM cand',
    "q23_resolved_merge": MERGED_SQL,
    "q24_threshold_override": _found_sql("score >= CASE entity_type WHEN 'IP_ADDRESS' THEN 0.8 WHEN 'SSN' THEN 0.3 ELSE 0.5 END"),
    "q25_disabled": _found_sql("score >= 0.5 AND entity_type NOT IN ('EMAIL', 'IP_ADDRESS')"),
    "q28_all_types": _found_sql("score >= 0.5"),
    "q34_mixed": f"WITH {_found_masked(_MIXED_PUT)} SELECT doc_id, masked_text FROM masked",
    "q41_session_mask": SESSION_MASK_SQL,
    "q90_flagship": f"WITH {_found_masked(_TOKEN)} SELECT doc_id, masked_text, n_tokens, true AS restored FROM masked",
    "q21_resolved_strict": RESOLVED_SQL,
    "q22_resolved_contained": CONTAINED_SQL,
    "q26_exclusions": _email + "SELECT doc_id, start, \"end\", 'EMAIL' AS entity_type, 0.95::DOUBLE AS score, false AS validated FROM f_email WHERE value <> 'user0@mail.example.org' AND NOT regexp_matches(value, '^user1')",
    "q27_custom_pattern": f"WITH {TEXTS}, p AS (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM texts WHERE contains(text, 'Released under the ')), c AS (SELECT doc_id, i, regexp_extract(substr(text, i, 400), '^Released under the ([{W}]+) License', 1) AS value FROM p) SELECT doc_id, CAST(i - 1 + 19 AS INTEGER) AS start, CAST(i - 1 + 19 + length(value) AS INTEGER) AS \"end\", value FROM c WHERE value <> ''",
    "q30_mask_replace": _email_masked("'<EMAIL_' || CAST(n AS VARCHAR) || '>'"),
    "q31_redact": _email_masked("'[REDACTED_EMAIL]'"),
    "q32_mask_tail": _email_masked("reverse(list_reduce(list_transform(string_split(reverse(value), ''), lambda c: c), lambda a, c: a || CASE WHEN regexp_matches(c, '[\\p{L}\\p{N}]') AND length(regexp_replace(a, '[^\\p{L}\\p{N}]', '', 'g')) >= 4 THEN 'X' ELSE c END, ''))"),
    "q33_hash": _email_masked(f"sha256({_pad[0]} || unhex(sha256({_pad[1]} || encode(value))))"),
    "q36_unmask_roundtrip": f"WITH {TEXTS} SELECT doc_id, text || ' <EMAIL_1> 😀' AS text FROM texts",
    "q37_reserved_guard": f"WITH texts AS (SELECT doc_id, {_DUCK} || ' <EMAIL_1>' AS text FROM documents), {rule_ctes('email')} SELECT doc_id, CAST(count(DISTINCT value) AS INTEGER) AS n, true AS avoided, true AS restored FROM texts LEFT JOIN f_email USING (doc_id) GROUP BY doc_id",
    "q40_session_tokens": SESSION_SQL,
    "q42_session_unmask": f"SELECT {_CONV.format(S='VARCHAR')} FROM conversations",
    "q50_json_mask": "SELECT event_id, '<EMAIL_1>' AS mail, 16 AS card_digits, false AS card_kept, event_type AS kind, user_id FROM events",
    "q51_json_typed": "SELECT event_id, 'to <EMAIL_1>|none' AS mails, 'host <IP_ADDRESS_1>' AS host, value AS v FROM events",
    "q60_pii_report": _all + "SELECT lang, entity_type, count(*) AS n, count(DISTINCT value) AS n_values FROM found JOIN texts USING (doc_id) GROUP BY lang, entity_type",
    "q61_pii_cube": _all + "SELECT lang, source, count(*) AS n FROM found JOIN texts USING (doc_id) GROUP BY CUBE (lang, source)",
    "q62_docs_without_pii": f"WITH {_found('score >= 0.5', 'texts AS (SELECT doc_id, text FROM documents)')} SELECT doc_id FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM found)",
    "q63_topk_docs": _all + "SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 20",
    "q70_mapping_encrypt_roundtrip": _email + ", firsts AS (SELECT doc_id, value, dense_rank() OVER (PARTITION BY doc_id ORDER BY min(start)) AS n FROM f_email GROUP BY doc_id, value) SELECT doc_id, '<EMAIL_' || CAST(n AS VARCHAR) || '>' AS token, value AS original FROM firsts",
}
