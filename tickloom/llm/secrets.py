"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of a path is content-addressed (SHA-256 of its text). A blob is scanned once per rule version: blobs the
ledger holds for this version are left out, copies meet in a partial aggregate, and the findings are joined back to
all paths. Spans come from the pieces between matches: a match starts after the lengths of all pieces and matches
before it, a running sum over the matches of one text and rule.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: The group whose length counts (0: the match) and the least length; shorter matches are dropped.
    group: int
    least: int
    #: Text without this literal holds no match ("" for none).
    literal: str
    #: The group, at the match's end, whose place is the span (0: the match).
    own: int = 0


RULE_VERSION = 3
#: Tasks that share the paths of one blob.
SALTS = 16
# The base rules, in the order of their kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    # The maximal runs of 24 and more are the maximal runs that are long enough.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, ""),
)
#: Rules of the method's own.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
    # Only where a run of token characters begins: each run is read once, however often it repeats its first letters.
    Rule("web_token", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0, 1, "eyJ", 1),
    Rule("url_login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", 0, 1, "://"),
)
RULES = BASE + ADDED


def _holds(text: Column, rule: Rule) -> Column:
    found = text.rlike(rule.pattern)
    return F.contains(text, F.lit(rule.literal)) & found if rule.literal else found


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """struct(number, kind, matches: array of struct(gap, size, own, fine)), null if the text holds none."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)

    def sizes(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)

    fine = F.transform(sizes(rule.group), lambda n: n >= rule.least)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(sizes(0))).alias("gap"), sizes(0).alias("size"), sizes(rule.own).alias("own"), fine.alias("fine"))
    return F.when(_holds(text, rule), F.struct(F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), zipped.alias("matches")))


def addressed(versions: DataFrame) -> DataFrame:
    """blob (SHA-256), text of each row; a null text is the empty one."""
    text = F.coalesce("text", F.lit(""))
    return versions.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """blob, text: every distinct text that ``ledger`` (blob, rule_version) has not under this rule version."""
    blobs = addressed(versions)
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    return blobs.groupBy("blob").agg(F.first("text").alias("text"))


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, number, kind, start, end (code points, end exclusive): one row per span of each text."""
    each = F.explode(F.filter(F.array(*[_matches(F.col("text"), n, r) for n, r in enumerate(rules)]), F.isnotnull)).alias("rule")
    rows = blobs.select("blob", each).select("blob", "rule.number", "rule.kind", F.posexplode("rule.matches").alias("at", "match"))
    so_far = Window.partitionBy("blob", "number").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("match.gap") + F.col("match.size")).over(so_far)
    return (rows.select("blob", "number", "kind", "match.own", "match.fine", end.alias("end")).filter("fine")
            .select("blob", "number", "kind", (F.col("end") - F.col("own")).alias("start"), "end"))


def _onto_paths(paths: DataFrame, found: DataFrame) -> DataFrame:
    """``paths`` left-joined with ``found`` on ``__blob``; a blob of very many paths is dealt to ``SALTS`` tasks."""
    dealt = paths.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["__blob", "__salt"], "left").drop("__salt")


def scan(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings of all blobs, ledger, findings by path) after the rows of ``versions`` (path columns, text).

    ``ledger`` (blob, rule_version) and ``known`` (findings with rule_version) are those of earlier runs; only unseen
    pairs are scanned. The third table has every row of ``versions`` without its text, each with each of its spans
    under this rule version, or once with null spans. Extra columns stay, but for ``text``; a ``blob`` or ``span`` of
    theirs comes out as ``path_blob``, ``path_span``, and names that begin with two underscores are taken. Null and empty
    texts are one blob without findings, repeated rows stay, an empty table gives three empty ones.
    """
    new = unseen(versions, ledger, rule_version)
    found = findings(new, rules).withColumn("rule_version", F.lit(rule_version))
    entries = new.select("blob", F.lit(rule_version).alias("rule_version"))
    if known is not None:
        found = known.unionByName(found)
    if ledger is not None:
        entries = ledger.select("blob", "rule_version").unionByName(entries)
    address = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    paths = versions.withColumn("__blob", address).drop("text").withColumnsRenamed({"blob": "path_blob", "span": "path_span"})
    now = found.filter(F.col("rule_version") == rule_version).select(F.col("blob").alias("__blob"), F.struct("number", "kind", "start", "end").alias("span"))
    return found, entries, _onto_paths(paths, now).withColumnRenamed("__blob", "blob")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _number_of(rule: int) -> Column:
    return F.size(F.filter("found", lambda s: s.number == rule)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs`` (doc_id, text), scanned as blobs.

    Null and empty texts hold nothing; repeated rows and null ids each keep their row; an empty table gives none. Only
    doc_id and text are read, so other columns may have any name.
    """
    found = findings(unseen(docs))
    spans = F.array_sort(F.collect_list(F.struct("start", "number", "kind", "end")))
    by_blob = found.groupBy("blob").agg(spans.alias("found"))
    by_path = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__blob"))
    own = by_blob.select(
        F.col("blob").alias("__blob"), *[_number_of(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)],
        _joined(F.filter("found", lambda s: s.number < len(BASE))).alias("base"), _joined(F.col("found")).alias("spans"))
    return _onto_paths(by_path, own).select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the registered query, by the same rules."""
    parts = []
    for number, rule in enumerate(rules):
        p = _quoted(re.sub(r"\\x20", " ", rule.pattern))
        parts.append(f"""select row, {number} as number, '{rule.kind}' as kind,
          list_transform(regexp_extract_all(text, {p}, 0), lambda x: length(x)) as sizes,
          list_transform(regexp_extract_all(text, {p}, {rule.own}), lambda x: length(x)) as owns,
          list_transform(regexp_extract_all(text, {p}, {rule.group}), lambda x: length(x) >= {rule.least}) as fine,
          list_transform(string_split_regex(text, {p}), lambda x: length(x)) as gaps
          from docs where regexp_matches(text, {p})""")
    counts = ", ".join(f"count(*) filter (number = {n}) as n_{r.kind}" for n, r in enumerate(BASE))
    names = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)
    return f"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
arrays as ({" union all ".join(parts)}),
matches as (select row, number, kind, generate_subscripts(sizes, 1) as nth, unnest(sizes) as size, unnest(owns) as own, unnest(fine) as fine, unnest(gaps[1:len(sizes)]) as gap from arrays),
ends as (select *, cast(sum(gap + size) over (partition by row, number order by nth) as bigint) as stop from matches),
spans as (select row, number, stop - own as start, kind || ':' || (stop - own) || ':' || stop as span from ends where fine),
by_row as (select row, {counts}, string_agg(span, ',' order by start, number) as spans, string_agg(span, ',' order by start, number) filter (number < {len(BASE)}) as base from spans group by row)
select doc_id, {names}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join by_row using (row)
"""
