"""Detection as column expressions: candidates, scores, overlap resolution and exclusions, one row a text, no shuffle.

Values that are used more than once are bound as lambda variables (`let`): a column that is built into a later one is
otherwise evaluated at each place that uses it. A rule's regular expressions run only on texts that pass its cheap
necessary pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model
from ..functions.regex import groups, to_java
from ..functions.rules import CONTAINED, MERGE, VALIDATORS, WINDOW, Detection, Rule, boosted, native

SPAN = "struct<start:int,end:int,entity_type:string,score:double,recognizer:string,text:string,validated:boolean,explanation:array<string>,ordinal:int>"
GAP = r"^[\s\x1c-\x1f\x85\p{Z}]?[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]?[\s\x1c-\x1f\x85\p{Z}]?\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def nothing(of: str = SPAN) -> Column:
    return F.array().cast(f"array<{of}>")


def _places(text: Column, pattern: str) -> Column:
    """Array of (a, v): code-point offset and text of each match, from the gaps that split leaves between matches."""
    rx = F.lit(pattern)
    return let(
        F.regexp_extract_all(text, rx, F.lit(0)),
        lambda m: F.when(F.size(m) == 0, F.array().cast("array<struct<a:int,v:string>>")).otherwise(
            let(
                F.split(text, pattern),
                lambda gap: F.aggregate(
                    F.sequence(F.lit(1), F.size(m)),
                    F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,v:string>>").alias("o")),
                    lambda acc, i: let(
                        acc["at"] + F.length(F.element_at(gap, i)),
                        lambda a: F.struct((a + F.length(F.element_at(m, i))).alias("at"), F.concat(acc["o"], F.array(F.struct(a.alias("a"), F.element_at(m, i).alias("v")))).alias("o")),
                    ),
                    lambda acc: acc["o"],
                ),
            )
        ),
    )


def _group_places(text: Column, rule: Rule) -> Column:
    """The same for a pattern whose first group is the finding. The group's place in its match: the match is parsed
    again, anchored, with the part before the group captured."""
    py = rule.pattern
    depth, at = 0, -1
    i = 0
    while i < len(py):  # the first capturing parenthesis
        if py[i] == "\\":
            i += 2
            continue
        if py[i] == "[":
            i = py.index("]", i + 2)
        elif py[i] == "(" and (not py.startswith("(?", i) or py.startswith("(?P<", i)):
            at = i
            break
        elif py[i] == "(":
            depth += py[i + 1 : i + 3] == "?:"
        elif py[i] == ")":
            depth -= 1
        i += 1
    flags = py[: py.index(")") + 1] if py.startswith("(?i)") else ""
    head = to_java(flags + "(" + py[len(flags) : at] + ")" + py[at:])
    return F.transform(
        _places(text, to_java(py)),
        lambda p: F.struct((p["a"] + F.length(F.regexp_extract(p["v"], head, 1))).alias("a"), F.regexp_extract(p["v"], head, 2).alias("v")),
    )


def splittable(rule: Rule) -> bool:
    """Whether the column path can run the rule; others go through Python's engine in Arrow batches."""
    if native(rule) is None:
        return False
    if groups(rule.pattern) == 0:
        return True
    body = rule.pattern.removeprefix("(?i)")
    # a group inside another group, or behind an outer alternation or look-behind, has no fixed place
    first = body.index("(") if "(" in body else 0
    return "|" not in _outer(body) and "(?<" not in body[first:] and _outer_group(body)


def _outer(p: str) -> str:
    out, depth, i = [], 0, 0
    while i < len(p):
        if p[i] == "\\":
            i += 2
            continue
        if p[i] == "[":
            i = p.index("]", i + 2)
        elif p[i] == "(":
            depth += 1
        elif p[i] == ")":
            depth -= 1
        elif depth == 0:
            out.append(p[i])
        i += 1
    return "".join(out)


def _outer_group(p: str) -> bool:
    depth, i = 0, 0
    while i < len(p):
        if p[i] == "\\":
            i += 2
            continue
        if p[i] == "[":
            i = p.index("]", i + 2)
        elif p[i] == "(":
            if not p.startswith("(?", i) or p.startswith("(?P<", i):
                return depth == 0 and p[p.index(")", i) + 1 : p.index(")", i) + 2] not in ("?", "*", "{")
            depth += 1
        elif p[i] == ")":
            depth -= 1
        i += 1
    return False


def rule_spans(text: Column, rule: Rule, ordinal: int, d: Detection) -> Column:
    places = _group_places(text, rule) if groups(rule.pattern) else _places(text, to_java(rule.pattern))
    if rule.validator:
        places = F.filter(places, lambda p: VALIDATORS[rule.validator][0](p["v"]))
    if groups(rule.pattern):
        places = F.filter(places, lambda p: F.length(p["v"]) > 0)
    words = d.keywords.get(rule.entity, ())
    plain = F.lit(float(round(rule.score, 2)))

    def span(p: Column) -> Column:
        score = plain
        if words:
            before = F.substr(text, F.greatest(p["a"] - WINDOW, F.lit(0)) + 1, F.least(p["a"], F.lit(WINDOW)))
            after = F.substr(text, p["a"] + F.length(p["v"]) + 1, F.lit(WINDOW))
            score = let(F.lower(F.concat(before, F.lit(" "), after)), lambda near: F.when(_any([F.contains(near, F.lit(w)) for w in words]), F.lit(boosted(rule.score))).otherwise(plain))
        return F.struct(
            p["a"].alias("start"), (p["a"] + F.length(p["v"])).alias("end"), F.lit(rule.entity).alias("entity_type"), score.alias("score"), F.lit(f"pattern:{rule.entity}").alias("recognizer"),
            p["v"].alias("text"), F.lit(rule.validator is not None).alias("validated"), F.array().cast("array<string>").alias("explanation"), F.lit(ordinal).alias("ordinal"),
        )

    spans = F.transform(places, span).cast(f"array<{SPAN}>")
    return F.when(text.rlike(rule.needs), spans).otherwise(nothing()) if rule.needs else spans


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def candidates(text: Column, d: Detection) -> Column:
    """All rules' spans over one text, in rule order. Rules for Python's engine are not in here: see detect."""
    parts = [rule_spans(text, r, i, d) for i, r in d.active() if splittable(r)]
    return F.concat(*parts) if parts else nothing()


def resolve(spans: Column, text: Column, d: Detection) -> Column:
    """Greedy choice by (validated, score, length, start, rule), overlap policies, then order by start and merging."""
    by_type = {*d.thresholds, *d.overlaps}

    def enough(s: Column) -> Column:
        need = F.lit(float(d.threshold))
        for t in sorted(d.thresholds):
            need = F.when(s["entity_type"] == t, float(d.thresholds[t])).otherwise(need)
        return s["score"] >= need

    keyed = F.transform(
        F.filter(spans, enough),
        lambda s: F.struct((~s["validated"]).alias("a"), (-s["score"]).alias("b"), (s["start"] - s["end"]).alias("c"), s["start"].alias("d"), s["ordinal"].alias("e"), s.alias("s")),
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["s"])
    kinds = {d.policy(t) for t in by_type} | {d.overlap}

    def is_policy(s: Column, which: str) -> Column:
        yes = [t for t in sorted(by_type) if d.policy(t) == which]
        no = [t for t in sorted(by_type) if d.policy(t) != which]
        return (~s["entity_type"].isin(no) if no else F.lit(True)) if d.overlap == which else (s["entity_type"].isin(yes) if yes else F.lit(False))

    meets = lambda k, c: (k["start"] < c["end"]) & (c["start"] < k["end"])
    if CONTAINED not in kinds:
        step = lambda acc, c: F.when(F.exists(acc, lambda k: meets(k, c)), acc).otherwise(F.concat(acc, F.array(c)))
    else:

        def yields(k: Column, c: Column) -> Column:
            inside = ((c["start"] <= k["start"]) & (k["end"] <= c["end"])) | ((k["start"] <= c["start"]) & (c["end"] <= k["end"]))
            better = (c["validated"] & ~k["validated"]) | ((c["validated"] == k["validated"]) & (c["end"] - c["start"] < k["end"] - k["start"]))
            return inside & is_policy(k, CONTAINED) & better

        def step(acc: Column, c: Column) -> Column:
            blocked = F.exists(acc, lambda k: meets(k, c) & ~yields(k, c))
            why = F.transform(F.filter(acc, lambda k: meets(k, c)), lambda k: F.concat(F.lit("contained: preferred over "), k["recognizer"], F.lit(" span ["), k["start"].cast("string"), F.lit(":"), k["end"].cast("string"), F.lit("]")))
            new = c.withField("explanation", F.concat(c["explanation"], why)).cast(SPAN)
            return F.when(blocked, acc).otherwise(F.concat(F.filter(acc, lambda k: ~meets(k, c)), F.array(new)))

    kept = F.aggregate(ordered, nothing(), step)
    kept = F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s.alias("s")))), lambda k: k["s"])
    if MERGE not in kinds:
        return kept

    def join(acc: Column, s: Column) -> Column:
        p = F.element_at(acc, -1)
        adjacent = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["entity_type"] == s["entity_type"]) & is_policy(s, MERGE)
        adjacent = adjacent & F.substr(text, F.get(acc, F.size(acc) - 1)["end"] + 1, s["start"] - F.get(acc, F.size(acc) - 1)["end"]).rlike(GAP)
        p = F.get(acc, F.size(acc) - 1)
        one = F.struct(
            p["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), F.greatest(p["score"], s["score"]).alias("score"),
            F.concat(F.lit("merged("), p["recognizer"], F.lit("+"), s["recognizer"], F.lit(")")).alias("recognizer"), F.substr(text, p["start"] + 1, s["end"] - p["start"]).alias("text"),
            (p["validated"] | s["validated"]).alias("validated"), F.concat(p["explanation"], s["explanation"], F.array(F.lit("merged: adjacent same-type spans"))).alias("explanation"), p["ordinal"].alias("ordinal"),
        ).cast(SPAN)
        return F.when(F.coalesce(adjacent, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(kept, nothing(), join)


def excise(text: Column, spans: Column) -> Column:
    """Ranges of the spans blanked, the length kept."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit(model.BLANKED), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def exclude(spans: Column, d: Detection) -> Column:
    if d.exclude_values:
        spans = F.filter(spans, lambda s: ~s["text"].isin(*d.exclude_values))
    for p in map(to_java, d.exclude_patterns):
        spans = _without(spans, p)
    return spans


def _without(spans: Column, pattern: str) -> Column:
    return F.filter(spans, lambda s: (F.length(s["text"]) > 10_000) | ~s["text"].rlike(pattern))


def detect(df: DataFrame, column: str = "text", d: Detection = Detection(), out: str = "spans") -> DataFrame:
    """df with an array of findings: non-overlapping, sorted by start. Null text: null. Offsets are code points."""
    t = F.col(column)
    python_rules = [(i, r) for i, r in d.active() if not splittable(r)]
    if not python_rules and not d.ner:
        spans = let(candidates(t, d), lambda c: exclude(resolve(c, t, d), d))
        return df.withColumn(out, F.when(t.isNotNull(), spans))
    return df.withColumn(out, _python_detect(t, d))


def _rows(spans: list[model.Span]) -> list[dict]:
    return [{"start": s.start, "end": s.end, "entity_type": s.entity_type, "score": s.score, "recognizer": s.recognizer, "text": s.text, "validated": s.validated, "explanation": list(s.explanation), "ordinal": s.ordinal} for s in spans]


def _python_detect(text: Column, d: Detection) -> Column:
    """The whole run in Arrow batches, for a named-entity model or patterns that only Python's engine knows. A model is
    loaded by the function itself, once a worker."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else _rows(model.detect(t, d)))

    return run(text)


def each(df: DataFrame, spans: Column | str, out: str = "s") -> DataFrame:
    """One row an element, in column out. Outer, and nulls filtered afterwards: for a plain explode the optimizer adds
    filters on the array's size below it, which would evaluate the whole expression again."""
    return df.withColumn(out, F.explode_outer(spans)).where(F.col(out).isNotNull())


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row a finding: df's other columns, then the span's fields."""
    return each(df, spans, "_s").select(*[c for c in df.columns if c != spans], *[F.col(f"_s.{x}").alias(x if x != "text" else "value") for x in ("start", "end", "entity_type", "score", "recognizer", "text", "validated", "explanation")])
