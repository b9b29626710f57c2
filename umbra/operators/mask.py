"""Substitution as column expressions: one fold over a text's spans builds the masked text and its mapping."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model, surrogates
from ..functions.model import Policy
from ..functions.rules import Detection
from .detect import detect, let

ENTRY = "struct<token:string,entity_type:string,strategy:string,reversible:boolean,original:string>"
#: Java pattern of texts that look like tokens.
RESERVED = r"<[A-Z0-9_]+_\p{Nd}+(?:_[0-9a-f]+)?>"
#: Tries for a free nonce or surrogate, as a bound on the expression.
TRIES = 20


def hmac_hex(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hexadecimal. The pads derive from the key and are visible in the plan: see README, security."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    pad = lambda x: F.lit(bytearray(b ^ x for b in key.ljust(64, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(value, "UTF-8")), 256))), 256)


def partly(value: Column, reveal_last: int, mark: str) -> Column:
    """Letters and digits become the mark but for the last ones; others stay."""
    alnum = r"[\p{L}\p{N}]"
    if reveal_last <= 0:
        return F.regexp_replace(value, F.lit(alnum), F.lit(_quoted(mark)))
    return F.regexp_replace(value, F.lit(alnum + r"(?=(?:[^\p{L}\p{N}]*+" + alnum + "){" + str(reveal_last) + "})"), F.lit(_quoted(mark)))


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def nonce(secret: bytes, token: Column, value: Column, n: Column) -> Column:
    return F.substr(F.sha2(F.concat(F.lit(bytearray(secret)), F.encode(F.concat(token, F.lit("|"), value, F.lit("|"), n.cast("string")), "UTF-8")), 256), F.lit(1), F.lit(4))


def free_token(entity: Column, n: Column, value: Column, taken: Column, secret: bytes) -> Column:
    """<TYPE_n>, or with a keyed nonce the first that is not taken. Deterministic: a task's retry gives the same."""
    plain = F.concat(F.lit("<"), entity, F.lit("_"), n.cast("string"), F.lit(">"))
    return let(
        plain,
        lambda p: F.when(~F.array_contains(taken, p), p).otherwise(
            F.element_at(
                F.filter(
                    F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: F.concat(F.substr(p, F.lit(1), F.length(p) - 1), F.lit("_"), nonce(secret, p, value, k), F.lit(">"))),
                    lambda c: ~F.array_contains(taken, c),
                ),
                1,
            )
        ),
    )


def fixed(value: Column, entity: Column, strategy: Column, p: Policy) -> Column:
    """Substitute for the irreversible strategies."""
    out = F.concat(F.lit("[REDACTED_"), entity, F.lit("]"))
    hows = {p.default, *dict(p.per_entity).values()}
    if "mask" in hows:
        out = F.when(strategy == "mask", partly(value, p.reveal_last, p.mask_char)).otherwise(out)
    if "hash" in hows:
        if p.hash_key is None:
            raise ValueError("the hash strategy needs a key")
        out = F.when(strategy == "hash", hmac_hex(value, p.hash_key)).otherwise(out)
    return out


def strategy_of(entity: Column, p: Policy) -> Column:
    out = F.lit(p.default)
    for t, how in p.per_entity:
        out = F.when(entity == t, how).otherwise(out)
    return out


def _first_free(entity: str, value: Column, text: Column, taken: Column, secret: bytes) -> Column:
    """Tries end at the first free value: the later ones are not computed."""

    def step(found: Column, k: Column) -> Column:
        made = let(surrogates.native(entity, value, secret, k), lambda c: F.when(~F.array_contains(taken, c) & ~F.contains(text, c) & (c != value), c))
        return F.when(found.isNotNull(), found).otherwise(made)

    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("string"), step)


def surrogate(entity: Column, value: Column, text: Column, taken: Column, p: Policy) -> Column:
    """The first free fake value of TRIES, or null (no generator, or all taken): then REPLACE's token is used."""
    out = F.lit(None).cast("string")
    for t in surrogates.HAS:
        if p.of(t) != "surrogate":
            continue
        out = F.when(entity == t, _first_free(t, value, text, taken, p.secret)).otherwise(out)
    return out


NEW = "struct<put:string,token:string,entity_type:string,strategy:string,reversible:boolean,original:string>"


def substitute(text: Column, spans: Column, p: Policy) -> Column:
    """struct(masked_text, mapping): mapping entries in order of issue; irreversible ones under an audit token.

    Distinct values are numbered once and looked up for each span; tokens that stand in the text are found once.
    """
    if p.needs_key() and p.hash_key is None:
        raise ValueError("the hash strategy needs a key")
    hows = {p.default, *dict(p.per_entity).values()}
    of = lambda s: F.concat(s["entity_type"], F.lit("\0"), s["text"])
    kind = lambda k: F.substring_index(k, "\0", 1)

    def made(k: Column, keys_of: Column, reserved: Column, fakes: Column | None) -> Column:
        def entry(t: Column, value: Column) -> Column:
            how, n = strategy_of(t, p), F.array_position(F.element_at(F.filter(keys_of, lambda g: g["t"] == t), 1)["k"], k)
            token, rev = free_token(t, n, value, reserved, p.secret), how.isin("replace", "surrogate")
            fake = F.lit(None).cast("string") if fakes is None else surrogate(t, value, text, F.concat(reserved, fakes), p)
            return let(
                F.struct(token.alias("t"), fake.alias("f")),
                lambda x: F.struct(
                    F.coalesce(x["f"], F.when(rev, x["t"]).otherwise(fixed(value, t, how, p))).alias("put"), F.coalesce(x["f"], x["t"]).alias("token"), t.alias("entity_type"),
                    F.when(x["f"].isNull() & (how == "surrogate"), "replace").otherwise(how).alias("strategy"), rev.alias("reversible"), value.alias("original"),
                ).cast(NEW),
            )

        return let(kind(k), lambda t: entry(t, F.substr(k, F.length(t) + 2)))

    def entries(keys: Column, keys_of: Column, reserved: Column) -> Column:
        if "surrogate" not in hows:
            return F.transform(keys, lambda k: made(k, keys_of, reserved, None))
        return F.aggregate(  # a fake must differ from those before it
            keys,
            F.struct(F.array().cast(f"array<{NEW}>").alias("e"), F.array().cast("array<string>").alias("f")),
            lambda acc, k: let(made(k, keys_of, reserved, acc["f"]), lambda e: F.struct(F.concat(acc["e"], F.array(e)).alias("e"), F.concat(acc["f"], F.array(e["token"])).alias("f"))),
            lambda acc: acc["e"],
        )

    def built(keys: Column, made_: Column) -> Column:
        put = lambda s: F.element_at(made_, F.array_position(keys, of(s)).cast("int"))["put"]
        from_ = lambda i: F.when(i == 0, 0).otherwise(F.element_at(spans, F.greatest(i, F.lit(1)))["end"])
        pieces = F.transform(spans, lambda s, i: F.concat(F.substr(text, from_(i) + 1, s["start"] - from_(i)), put(s)))
        last = F.element_at(spans, -1)["end"]
        return F.struct(
            F.concat(F.array_join(pieces, ""), F.substr(text, last + 1, F.length(text) - last)).alias("masked_text"),
            F.transform(made_, lambda e: F.struct(*[e[c].alias(c) for c in ("token", "entity_type", "strategy", "reversible", "original")])).alias("mapping"),
        )

    def numbered(keys: Column) -> Column:
        keys_of = F.transform(F.array_distinct(F.transform(keys, kind)), lambda t: F.struct(t.alias("t"), F.filter(keys, lambda k: kind(k) == t).alias("k")))
        return let(F.struct(keys_of.alias("of"), F.regexp_extract_all(text, F.lit(RESERVED), F.lit(0)).alias("r")), lambda x: let(entries(keys, x["of"], x["r"]), lambda e: built(keys, e)))

    return let(F.array_distinct(F.transform(spans, of)), numbered)


def _python_substitute(text: Column, spans: Column, p: Policy) -> Column:
    """The same in Arrow batches, for generators that were registered as Python functions."""
    extra = dict(surrogates.EXTRA)

    @F.pandas_udf(f"struct<masked_text:string,mapping:array<{ENTRY}>>")
    def run(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        surrogates.EXTRA.update(extra)
        out = []
        for t, s in zip(texts, found):
            if t is None or s is None:
                out.append((t, []))
                continue
            masked, entries = model.substitute(t, [(x["start"], x["end"], x["entity_type"]) for x in s], p)
            out.append((masked, [{k: getattr(e, k) for k in ("token", "entity_type", "strategy", "reversible", "original")} for e in entries]))
        return pd.DataFrame(out, columns=["masked_text", "mapping"])

    return run(text, spans)


def unmask(text: Column, mapping: Column) -> Column:
    """Reversible tokens back to their originals, in the order they were issued."""
    return F.aggregate(mapping, text, lambda t, e: F.when(~e["reversible"], t).when(e["token"].rlike("^[0-9]+$"), F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{Nd})"), e["token"], F.lit(r"(?!\p{Nd})")), e["original"])).otherwise(F.replace(t, e["token"], e["original"])))


def mask(df: DataFrame, column: str = "text", d: Detection = Detection(), p: Policy = Policy(), spans: str | None = None) -> DataFrame:
    """df with masked_text and mapping. spans: a column of findings that is there already. Null text: null and no entries."""
    found = df if spans else detect(df, column, d, "_spans")
    t, s = F.col(column), F.col(spans or "_spans")
    own = any(p.of(e) == "surrogate" for e in surrogates.EXTRA)
    both = F.when(t.isNotNull(), F.when(F.size(s) > 0, _python_substitute(t, s, p) if own else substitute(t, s, p)).otherwise(F.struct(t.alias("masked_text"), F.array().cast(f"array<{ENTRY}>").alias("mapping"))))
    out = found.withColumn("_m", both).withColumn("masked_text", F.col("_m.masked_text")).withColumn("mapping", F.coalesce("_m.mapping", F.array().cast(f"array<{ENTRY}>")))
    return out.drop("_m", "_spans")


def mask_and_call(df: DataFrame, call, column: str = "text", d: Detection = Detection(), p: Policy = Policy(), out: str = "answer") -> DataFrame:
    """Mask, pass the masked text through call(str) -> str in Arrow batches, restore the answer."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else call(x))

    m = mask(df, column, d, p).withColumn("_answer", run("masked_text"))
    return m.withColumn(out, unmask(F.col("_answer"), F.col("mapping"))).drop("_answer")


def check_hmac(value: str, key: bytes) -> str:
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()
