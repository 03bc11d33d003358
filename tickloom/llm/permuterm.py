"""Spelling variants by permuterm rotations: words one inserted, deleted or replaced code point apart.

Words end in a terminator and are rotated. The rotation that starts behind the code point i ends in that code point,
so what is before it is the word without it: all words that differ there only share this prefix, and the word that
lacks the code point has the prefix as a whole rotation. Rotations are shuffled by their prefix and sorted; a group is
one run of the sorted rows, at most as long as there are different last code points. In a run the best neighbour of a
row is the first row, or the second for the first itself, so a row a rotation leaves the scan and no pairs are formed.

A neighbour by replacement shares exactly one prefix. One by deletion shares a prefix for every position of a run of
equal code points; it is counted at the first one only.

Forms point to words of at least twice the count, so their chains end; roots are found by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.session import stable

#: The letters of a run, and the terminator, which is none of them.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
END = "$"
LOWER = str.maketrans({c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
#: A run loses one code point where this divides the checksum of its id and itself.
NOISE = 97
MIN_POINTS = 5
MIN_COUNT = 3
RATIO = 2
#: Distinct words a task holds before it hands their counts on.
HELD = 200_000


def word_counts(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n of the distinct words of whole texts; counts are added up in the tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": list(held.keys()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
                    if noise:
                        h = zlib.crc32(word.encode(), own)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                    if len(word) >= min_points:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, word, n, skipped, first: a row for every rotation of every word of ``words`` (word, n).

    ``skipped`` is the code point behind the prefix, null where the prefix is the whole rotation. ``first``: the code
    point before the skipped one is another.
    """
    word, length = F.col("word"), F.length("word")
    without = F.transform(F.sequence(F.lit(1), length), lambda i: F.struct(
        F.concat(F.substring(word, i + 1, length), F.lit(END), F.substring(word, F.lit(1), i - 1)).alias("prefix"),
        F.substring(word, i, F.lit(1)).alias("skipped"),
        ((i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1)))).alias("first")))
    whole = F.transform(F.sequence(F.lit(1), length + 1), lambda i: F.struct(
        F.concat(F.substring(word, i, length), F.lit(END), F.substring(word, F.lit(1), i - 1)).alias("prefix"),
        F.lit(None).cast("string").alias("skipped"), F.lit(False).alias("first")))
    return words.select("word", "n", F.explode(F.concat(without, whole)).alias("r")).select("r.prefix", "word", "n", "r.skipped", "r.first")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (n, word): how many words are near, and the near one of largest n (ties: smallest word)."""
    run = Window.partitionBy("prefix")
    ranked = run.orderBy(F.desc("n"), "word")
    whole = F.col("skipped").isNull()
    other = F.struct((-F.first("n").over(ranked)).alias("less"), F.first("word").over(ranked).alias("word"))
    second = F.struct((-F.lead("n").over(ranked)).alias("less"), F.lead("word").over(ranked).alias("word"))
    seen = (rotations(words)
            .withColumn("members", F.count_if(~whole).over(run)).withColumn("firsts", F.count_if(F.col("first")).over(run))
            .withColumn("wholes", F.count_if(whole).over(run)).withColumn("place", F.row_number().over(ranked))
            .withColumn("best", F.when(F.col("place") == 1, second).otherwise(other))
            .filter("members + wholes > 1")
            .withColumn("near", F.when(whole, F.col("firsts")).otherwise(F.col("members") - 1 + F.when(F.col("first"), F.col("wholes")).otherwise(0))))
    return seen.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that the forms of ``forms`` (word, form) lead to, the word itself without a form.

    Pointers double a round, so the rounds are the logarithm of the longest chain.
    """
    links = stable(forms.filter("form is not null").select("word", F.col("form").alias("to")))
    while True:
        ahead = links.select(F.col("word").alias("__word"), F.col("to").alias("__to"))
        moved = stable(links.join(ahead, F.col("to") == F.col("__word"), "left").select("word", F.coalesce("__to", "to").alias("to"), F.col("__to").isNotNull().alias("on")))
        if moved.filter("on").isEmpty():
            return forms.join(moved.select("word", "to"), "word", "left").select("word", F.coalesce("to", "word").alias("root"))
        links = moved.drop("on")


def variants(docs: DataFrame, ratio: int = RATIO, **limits: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text); other columns are not read.

    Null texts have no words; the checksum of a null id begins with the colon. Repeated rows count again, a text of
    any length counts whole, an empty table gives no rows.
    """
    words = stable(word_counts(docs, **limits))
    best = F.col("best.word").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    named = stable(words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best, F.col("best.word")).alias("form"), F.when(best, -F.col("best.less")).alias("form_n")))
    return named.join(roots(named.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")


#: DuckDB SQL of the registered query: a checksum by the reflected polynomial, near words by their deletions.
SQL = r"""
with crc_table as (
  select list_transform(range(256), lambda v: list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), counted as (
  select doc_id, run, count(*) as n from runs group by all
), points as (
  select *, list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda c: unicode(c)) as p from counted
), sums as (
  select doc_id, run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(p, lambda c: case when c < 128 then [c] else [192 + (c >> 6), 128 + (c & 63)] end))),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) as h
  from points, crc_table
), words as (
  select word, cast(sum(n) as bigint) as n from (
    select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from sums)
  where length(word) >= 5 group by word having sum(n) >= 3
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on c.rest = w.word
  union select w.word, c.word, c.n from cut c join words w on c.rest = w.word
), best as (
  select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word
), named as (
  select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * n then other end as form, case when other_n >= 2 * n then other_n end as form_n
  from words left join best using (word)
), recursive_roots as (
  with recursive chain as (
    select word, word as spot, form from named
    union all
    select c.word, n.word, n.form from chain c join named n on n.word = c.form
  ) select word, spot as root from chain where form is null
)
select word, form, root, n, n_near, form_n from named join recursive_roots using (word)
"""
