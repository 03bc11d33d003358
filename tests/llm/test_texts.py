"""Operators that judge each text by itself, against plain versions."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest

from tickloom.llm import language, licences, repetition, tokencount

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "word " * 60, "\U0001f600é " * 40, "a\x1cb c d", "x" * 100_000, "\n".join(["same line here"] * 4 + ["", "other"])]


def odd_docs(spark):
    """Odd texts under repeated and null ids, with columns named as the operators' own."""
    rows = [(None if i % 4 == 3 else i // 2, t, "en", i, 0.5, True) for i, t in enumerate(ODD * 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, score double, kept boolean")


def texts(limit=None):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()
    return rows[:limit]


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, window = len(words), 8
    seen = Counter(tuple(words[i:i + window]) for i in range(n - window + 1))
    inside = {j for i in range(n - window + 1) if seen[tuple(words[i:i + window])] > 1 for j in range(i, i + window)}
    longest = size = 8
    found = bool(inside)
    while found:
        longest = size
        size += 1
        runs = Counter(tuple(words[i:i + size]) for i in range(n - size + 1))
        found = any(c > 1 for c in runs.values())
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 20 or 100 * len(inside) > 30 * n
    kept = not failed and len(inside) <= 0.3 * n and (longest <= 100 or not inside)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(inside), failed, kept)


def test_quality_against_plain(spark):
    rng = random.Random(4)
    made = []
    for _ in range(80):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words) + 1)
            words += words[at:at + rng.randint(1, 60)]
        made.append(" ".join(words))
    made += ["lorem " + " ".join(map(str, range(150))) + " mid " + " ".join(map(str, range(150))) + " " + " ".join(f"w{i}" for i in range(900))]
    docs = spark.createDataFrame(list(enumerate(made + ODD)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:8]) for r in repetition.quality(docs).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(made + ODD)}
    assert repetition.quality(docs.limit(0)).count() == 0
    kept = repetition.passing(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == 0
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in repetition.passing(whole).select("doc_id").collect()) == [i for i, t, _ in texts() if plain_quality(t)[-1]]


def test_long_repeat_is_measured_in_words():
    run = " ".join(f"w{i}" for i in range(101))
    m = repetition._judge([f"{run} {' '.join(f'x{i}' for i in range(900))} {run}".encode()], 20, 8, 0.3, 100)
    assert m["longest"][0] == 101 and not m["base_failed"][0] and not m["kept"][0]


def test_language_learns_only_from_its_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    # Labels of the held-out rows are never read.
    from pyspark.sql import functions as F
    other = docs.withColumn("lang", F.when(language.fold(), "zz").otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(r.doc_id, r.lang_pred, r.score) for r in language.languages(other).collect()}


def test_language_of_odd_rows(spark):
    got = language.languages(odd_docs(spark)).collect()
    assert len(got) == 2 * len(ODD)
    assert Counter((r.lang_pred, r.score == 0) for r in got)["und", True] == 2 * 3
    assert {r.lang_pred for r in got} == {"en", "und"}
    assert {r.lang_pred for r in language.languages(odd_docs(spark).withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.languages(odd_docs(spark).limit(0)).count() == 0


def test_presence_kernel_is_the_plain_one():
    a, b = "ab ba!", "Bab"
    owners, buckets, has = language.gram_buckets([a, b, "12"])
    sets = [set(buckets[owners == i]) for i in range(3)]
    plain = [{s[i:i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "} for s in (" ab ba ", " bab ")]
    assert [len(s) for s in sets[:2]] == [len(p) for p in plain] and len(sets[0] & sets[1]) == len(plain[0] & plain[1])
    assert list(has) == [True, True, False]


def reference_tokenizer(pieces):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces))] + pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[ \\t-\\r]+"), "removed"), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
    return t


def test_token_counts_against_the_tokenizer(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    exact = reference_tokenizer(tokencount.vocabulary(path))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts(60)] + list(enumerate(ODD)), "doc_id long, text string")
    for (doc_id, text), row in zip([(r.doc_id, r.text) for r in docs.collect()], tokencount.token_counts(docs, path).collect()):
        assert (row.doc_id, row.n_tokens) == (doc_id, len(exact.encode(text or "", add_special_tokens=False).ids))
    assert tokencount.token_counts(docs.limit(0), path).count() == 0
    assert tokencount.token_counts(odd_docs(spark), path).count() == 2 * len(ODD)


def test_viterbi_ties():
    rng = random.Random(5)
    for _ in range(20):
        made = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(30)}
        pieces = [(p, rng.choice([-1.0, -2.0, -3.0])) for p in sorted(made) if "▁" not in p[1:] and p != "b"]
        own, exact = tokencount.Counter(pieces), reference_tokenizer(pieces)
        for _ in range(60):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert own.count("▁" + word) == len(exact.encode(word, add_special_tokens=False).ids)


def plain_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))


def test_licences_against_plain(spark):
    notice = licences.TEMPLATES["mit-notice"][0]
    made = ["MIT License, mit-license; MIT/LICENSE (GNU) General Public License general public", "mit license mit xlicense", f"intro {notice.upper()} outro", notice.replace("charge", "money"),
            notice.replace("associated", "other related"), "ALL rights\nreserved. Under CC BY-NC 4.0: Licensed under CC BY-NC 4.0.", "the of in " * 3000]
    rows = [(i, t) for i, t, _ in texts()] + [(1000 + i, t) for i, t in enumerate(made)] + [(2000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_phrases(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert ("reserved" in r.labels.split(",")) == bool(re.search(r"(?i)\ball rights\s+reserved\b", text or ""))
    assert "mit-notice" in got[1002].labels and "mit-notice" not in got[1003].labels and "mit-notice" in got[1004].labels and got[1004].score < 1
    assert got[1006].labels == "" and got[1006].score == 0
    assert licences.scan(docs.limit(0)).count() == 0 and licences.scan(odd_docs(spark)).count() == 2 * len(ODD)


def test_licences_of_many_notices(spark):
    lines = {name: line for name, (line, _) in licences.TEMPLATES.items()}
    notices = [n for n in lines if n.endswith("-notice")]
    made = {1: list(lines), 2: [*notices, "reserved"], 3: list(reversed(lines)), 4: [*lines] * 3}
    rows = [(10 + i, t) for i, t, _ in texts()] + [(i, "\n\n".join(lines[n] for n in names)) for i, names in made.items()]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, names in made.items():
        assert set(names) <= set(got[i].labels.split(",")), i


def test_licences_beside_stray_votes():
    # A stray vote before an alignment that is shifted in itself does not cut it.
    index = licences.Index({}, 0)
    line = index.lines["bsd-notice"]
    votes = [(at, w) for at, w in enumerate(line) if any(n == "bsd-notice" for n, _ in index.postings.get(w, ()))]
    body = line[:9] + [b"x"] * 6 + line[9:]
    for word in {w for _, w in votes}:
        for gap in range(1, 12):
            words = [b"y"] * 20 + [word] + [b"y"] * gap + body
            assert "bsd-notice" in index.scan(words)[1], (word, gap)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_language_id", "op7_token_counts", "op9_license_scans"])
def test_query_has_every_row(spark, name):
    from tickloom.llm.queries import R

    assert sorted(r.doc_id for r in R.queries[name](spark, SF).select("doc_id").collect()) == [i for i, _, _ in texts()]
