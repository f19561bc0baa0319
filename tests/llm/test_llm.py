"""Each operator against a plain version of itself, and on nulls, empty and repeated rows, empty tables and
clashing column names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import decontaminate, lang_id, license_scan, line_dedup, lz_fingerprint, merkle, mixing, ngram_join, pii, quality_knn, queries, tokens
from terrapanel.llm.components import connected_components
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def odd(spark):
    """Nulls, empty and repeated rows, one very long text, and columns whose names operators use."""
    rows = [(0, None, "x", 1), (1, "", None, 2), (1, "", None, 2), (None, "some words stand here", "x", 3), (2, "a b c d e f " * 3000, "y", 4), (3, "é " * 5, None, 5), (4, "one\ntwo\nthree\none\ntwo\nthree", "y", 6)]
    return spark.createDataFrame([(a, b, c, d, "z", 7, 8) for a, b, c, d in rows], f"{DOCS}, source string, part int, result string, n int, n_lines int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


# Tokens.


def test_words_and_hashes_equal_patterns():
    texts = ["Ab  c\td", None, "", "é1.x—y", "\n", "last"]
    for kind, pattern in ((tokens.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (tokens.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen, got = {}, defaultdict(list)
        for i, j, data, starts, ends in tokens.pieces(pa.array(texts), 4):
            hashes, row = tokens.word_hashes(data, starts, ends, kind)
            for h, r in zip(hashes, row, strict=True):
                got[i + r].append(h)
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        for k, words in enumerate(want):
            assert len(words) == len(got[k])
            for w, h in zip(words, got[k], strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


# 1. Merkle audit.


def test_merkle_audit_finds_only_the_faults(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert merkle.audit(pages, pages.orderBy(F.desc("page_id"))).count() == 0
    found = {(r["page_id"], r["status"]) for r in merkle.audit(pages, queries.damaged_replica(pages)).collect()}
    ids = [r[0] for r in pages.select("page_id").collect()]
    want = {(i, "missing") for i in ids if i % 193 == 7} | {(i, "changed") for i in ids if i % 97 == 5 and i % 193 != 7} | {(-1 - i, "extra") for i in ids if i % 389 == 11}
    assert found == want
    a, b = merkle.roots(pages).first()["hash"], merkle.roots(queries.damaged_replica(pages)).first()["hash"]
    assert a != b and a == merkle.roots(pages.orderBy(F.rand(1))).first()["hash"]


def test_merkle_audit_of_odd_rows(spark):
    kind = "page_id long, url string, html string"
    rows = [(None, "u", "h"), (1, None, "h"), (1, "", "h"), (2, "u", None), (2, "u", None), (3, "u", "")]
    a = spark.createDataFrame(rows, kind)
    assert merkle.audit(a, a).count() == 0
    got = merkle.audit(a, spark.createDataFrame(rows[:4] + [(3, "u", None)], kind)).collect()
    assert sorted((r["page_id"], r["copy"], r["status"]) for r in got) == [(2, 2, "missing"), (3, 1, "changed")]
    none = spark.createDataFrame([], kind)
    assert merkle.audit(none, none).count() == 0 and merkle.audit(a, none).count() == 6 and {r["status"] for r in merkle.audit(none, a).collect()} == {"extra"}


# 2. Pseudonyms.


def _prf(key, tag, i, value):
    return int(hashlib.sha256(f"{key}|{tag}|{i}|{value}".encode()).hexdigest()[:15], 16)


def _feistel(h, low, a, b, tag, key):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            h = (h + _prf(key, tag, i, low) % a) % a
        else:
            low = (low + _prf(key, tag, i, h) % b) % b
    return h, low


def _luhn(digits):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits)))) % 10 == 0


def test_pseudonyms_equal_a_plain_feistel(spark):
    random.seed(3)
    cards = []
    while len(cards) < 20:
        n = "".join(random.choice("0123456789") for _ in range(random.choice([13, 15, 16, 19])))
        if _luhn(n):
            cards.append(n)
    got = [r["text"] for r in pii.pseudonymize(docs(spark, cards + ["10.20.30.40"]), "k").orderBy("doc_id").collect()]
    for n, new in zip(cards, got[:-1], strict=True):
        body, u = n[:-1], (len(n) - 1) // 2
        h, low = _feistel(int(body[:u]), int(body[u:]), 10**u, 10 ** (len(body) - u), f"card{len(body)}", "k")
        moved = f"{h:0{u}d}{low:0{len(body) - u}d}"
        assert new == moved + next(c for c in "0123456789" if _luhn(moved + c)) and _luhn(new)
    h, low = _feistel(10 * 256 + 20, 30 * 256 + 40, 65536, 65536, "ip", "k")
    assert got[-1] == f"{h // 256}.{h % 256}.{low // 256}.{low % 256}"


def test_pseudonyms_keep_format_links_and_the_rest(spark):
    texts = ["call +1 (706) 555-3138 or 4111 1111-1111 1111, 4111111111111112", "born 2024-02-29, 31/12/1999; not 2023-02-29", "123-45-6789 and 000-12-3456", "at 15.193.86.107. x 256.1.1.1 5.12.", "Me.9@mail.example.com", "4111-1111-1111-1111", None, ""]
    out = pii.pseudonymize(docs(spark, texts), "k").orderBy("doc_id").collect()
    new = [r["text"] for r in out]
    shape = lambda t: re.sub("[0-9]", "9", t)
    assert shape(new[0]) == shape(texts[0]) and new[0].startswith("call +1 (") and new[0].endswith(" 4111111111111112") and new[0] != texts[0]
    assert shape(new[1]) == shape(texts[1]) and new[1].endswith("not 2023-02-29") and "2024-02-29" not in new[1]
    assert new[2].endswith("and 000-12-3456") and re.match(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} ", new[2])
    assert new[3].endswith(". x 256.1.1.1 5.12.") and "15.193.86.107" not in new[3]
    assert re.fullmatch(r"u[0-9a-f]{16}@mail\.example\.com", new[4])
    digits = lambda t: re.sub("[^0-9]", "", t)
    assert digits(new[5]) in digits(new[0]) and new[6] is None and new[7] == ""
    assert [sum(out[k][f"n_{kind}"] for kind in pii.KINDS) for k in range(8)] == [2, 2, 1, 1, 1, 1, 0, 0]
    assert pii.pseudonymize(docs(spark, texts), "other").orderBy("doc_id").first()["text"] != new[0]


def test_pseudonyms_are_a_permutation(spark):
    all_days = spark.sql("SELECT id AS doc_id, CAST(date_add(DATE'1999-01-01', CAST(id AS INT)) AS STRING) AS text FROM range(1500)")
    assert pii.pseudonymize(all_days, "k").select("text").distinct().count() == 1500


# 3. N-gram join.


def _components(texts, size=5, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_ngram_components_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150]))] for _ in range(25)]
    texts = [None, "", " \n", "One", "one", "ONE two"]
    common = [rng.choice(vocabulary) for _ in range(40)]
    for words in base:
        for _ in range(rng.choice([1, 2, 8])):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed + (common if rng.random() < 0.4 else [])))
    got = [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == _components(texts)


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(160)]
    texts = []
    for _ in range(250):
        changed = list(words)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            changed[rng.randrange(160)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    got = [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == _components(texts)


def test_ngram_components_of_odd_rows(spark):
    out = ngram_join.ngram_jaccard_components(odd(spark)).collect()
    assert len(out) == 7
    by_id = defaultdict(list)
    for r in out:
        by_id[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by_id[0] == [(0, 0)] and by_id[1] == [(0, 1)] * 2 and by_id[None] == [(1, None)] and by_id[2] == [(6, 2)]
    assert ngram_join.ngram_jaccard_components(odd(spark).limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


# 4. Licences.


@pytest.fixture(scope="module")
def licence_model(spark):
    return license_scan.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_licences_are_found_and_prose_is_not(spark, licence_model):
    texts = ["Words.\nReleased under the MIT License.\nMore words.", "RELEASED UNDER THE MIT LICENSE.", "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", "He showed his driving licence at the MIT gate.", "All rights reserved.", None, "", "Licensed under CC BY-NC 4.0."]
    out = [(r["n_paragraphs"], r["licenses"]) for r in license_scan.license_findings(docs(spark, texts), licence_model).orderBy("doc_id").collect()]
    assert out == [(3, "mit"), (1, "mit"), (2, "apache-2.0,gpl-3.0"), (1, ""), (1, ""), (0, ""), (1, ""), (1, "cc-by-nc")]


def test_licence_scan_equals_a_pattern_on_documents(spark, licence_model):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: len(re.findall(r"(?i)(apache\W+license|mit\W+license|general\W+public\W+license|cc\W+by\W+nc)", r["text"])) for r in table.collect()}
    got = {r["doc_id"]: r["n_licenses"] for r in license_scan.license_findings(table, licence_model).collect()}
    assert got == want


def test_licence_scan_of_odd_rows(spark, licence_model):
    assert license_scan.license_findings(odd(spark), licence_model).count() == 7
    assert license_scan.license_findings(odd(spark).limit(0)).count() == 0


# 5. Language.


def test_language_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lang_id.language_id(table).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.95 and out["score"].between(0, 1).all()
    import zlib

    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]).all()


def test_language_of_odd_rows(spark):
    table = odd(spark).withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in lang_id.language_id(table).collect()}
    assert out[0]["lang_pred"] == "und" and out[1]["lang_pred"] == "und" and out[1]["score"] == 0 and out[2]["lang_pred"] == "en"
    digits = docs(spark, ["12 34", "words"]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_id.language_id(digits).collect()} == {"und"}
    kept = lang_id.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == 4
    assert lang_id.language_id(table.limit(0)).count() == 0


# 6. Decontamination.


def _contamination(texts, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(pattern, (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[p : p + k])].add(str(item))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if items_here := windows.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= items_here
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefg") + rng.choice("hij")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 13, 14, 40])))) for k in range(12)] + [(12, None), (13, ""), (14, "...")]
    items.append((15, items[5][1]))
    texts = [None, "", "...", "Z"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        if rng.random() < 0.5:
            chosen = rng.choice(items)[1] or ""
            parts += [chosen.upper() if rng.random() < 0.3 else chosen, " ".join(word() for _ in range(rng.randrange(60)))]
        texts.append("  ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = [tuple(r[c] for c in columns) for r in decontaminate.contamination(docs(spark, texts), bench).orderBy("doc_id").collect()]
    assert got == _contamination(texts, items)


def test_longest_match_and_removal(spark):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = ["x " + " ".join(words[5:35]) + " y", "clean text", " ".join(["z"] * 1000 + words[:13])]
    out = decontaminate.contamination(docs(spark, texts), bench).orderBy("doc_id").collect()
    assert [(r["longest_match"], r["longest_at"], r["longest_item"]) for r in out] == [(30, 1, "1"), (0, None, None), (13, 1000, "1")]
    assert [[tuple(h) for h in r["hits"]] for r in out] == [[(1, 30)], [], [(1000, 1012)]] and [r["contaminated"] for r in out] == [True, False, False]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs(spark, texts), bench).orderBy("doc_id").collect()] == [1, 2]


def _longest(text, items):
    """(words, first word, item) of the longest run of words that the text shares with an item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, best = split(text), (0, 0, "")
    for item, t in items:
        v = split(t)
        for p in range(len(w)):
            for s in range(len(v)):
                k = 0
                while p + k < len(w) and s + k < len(v) and w[p + k] == v[s + k]:
                    k += 1
                if k >= 2:
                    best = min(best, (-k, p, str(item)))
    return (-best[0], best[1], best[2]) if best[0] else (0, None, None)


@pytest.mark.parametrize("block", [1 << 22, 2500])
def test_longest_matches_equal_brute_force(spark, monkeypatch, block):
    """Items repeated a thousand times under one id and under many, one block and three."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(18)
    word = lambda: rng.choice("abc") + rng.choice("de")
    distinct = [(f"i{k}", " ".join(word() for _ in range(rng.choice([3, 12, 13, 30])))) for k in range(8)]
    items = distinct + [distinct[3]] * 1000 + [(f"i{k}", distinct[4][1]) for k in range(100, 1100)]
    texts = ["", None, "ad"] + [" ".join([word() for _ in range(20)] + distinct[rng.randrange(8)][1].split()[rng.randrange(3) :] + [word() for _ in range(5)]) for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate._items(bench)[1] >= (3 if block == 2500 else 1)
    out = decontaminate.contamination(docs(spark, texts), bench).orderBy("doc_id").collect()
    once = sorted(set(items))
    least = [("i100" if k == 4 else i, t) for k, (i, t) in enumerate(distinct)]
    assert [(r["longest_match"], r["longest_at"], r["longest_item"]) for r in out] == [_longest(t, least) for t in texts]
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert [tuple(r[c] for c in columns) for r in out] == _contamination(texts, once)
    for r, text in zip(out, texts, strict=True):
        assert sum(h["last"] - h["first"] + 1 for h in r["hits"]) == r["n_hit"]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    seq = rng.integers(0, 4, 3000).astype(np.uint64)
    seq[1000:1200] = seq[500:700]
    seq[-1] = 0
    array = decontaminate.suffix_array(seq)
    ends = np.flatnonzero(seq == 0)
    suffix = [tuple(seq[p : ends[np.searchsorted(ends, p)]]) for p in array]
    assert sorted(array) == list(range(3000)) and all(a <= b for a, b in zip(suffix, suffix[1:], strict=False))


def test_decontamination_of_odd_rows(spark):
    table = odd(spark).withColumn("contamination", F.lit(1)).withColumn("state", F.lit("s"))
    bench = spark.createDataFrame([(None, "some words stand here"), (1, None)], "item_id long, text string")
    out = decontaminate.decontaminate(table, bench)
    assert out.columns == table.columns and out.count() == 6
    assert decontaminate.decontaminate(table, bench.limit(0)).count() == 7 and decontaminate.decontaminate(table.limit(0), bench).count() == 0


# 7. Quality.


def test_quality_on_held_out_documents(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_knn.quality_votes(table, labels).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() > 0.95


def test_votes_equal_a_plain_search():
    rng = np.random.default_rng(2)
    counts = rng.poisson(1.0, (120, quality_knn.TERMS)).astype(np.float32)
    labels = (rng.random(120) < 0.5).astype(float)
    space = quality_knn.fit(counts, labels)
    z = space.project(counts)
    want = []
    for row in z:
        near = np.argsort(-(space.vectors @ row))[: quality_knn.NEIGHBOURS]
        w = np.maximum(space.vectors[near] @ row, 1e-6).astype(float) ** 16
        want.append((w * labels[near]).sum() / w.sum())
    assert space.vote(counts, 7) == pytest.approx(want, abs=1e-5)
    assert space.vote(np.zeros((1, quality_knn.TERMS), np.float32)) == pytest.approx([labels.mean()])


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_knn.quality_votes(odd(spark), labels).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality_knn.quality_votes(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality_knn.quality_votes(odd(spark).limit(0), labels).count() == 0


# 8. Fingerprints.


def _phrases(data):
    seen, now = set(), b""
    for k in range(len(data)):
        now += data[k : k + 1]
        if now not in seen:
            seen.add(now)
            now = b""
    return seen | ({now} if now else set())


def test_fingerprints_equal_a_plain_parse(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id % 3 = 0")
    rows = sorted(map(tuple, table.collect()))
    got = {r["doc_id"]: r for r in lz_fingerprint.lz_fingerprints(table.repartition(5)).collect()}
    error = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = (text[: len(text) - half] + after[:half]).encode()
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited).hexdigest()
        assert r["edited_fingerprint"] == lz_fingerprint.fingerprint(edited).astype(">u4").tobytes().hex() and r["fingerprint"] == lz_fingerprint.fingerprint(text.encode()).astype(">u4").tobytes().hex()
        a, b, c = _phrases(text.encode()), _phrases(edited), _phrases(after.encode())
        error += [abs(r["near_edited"] - len(a & b) / len(a | b)), abs(r["near_next"] - len(a & c) / len(a | c))]
    assert max(error) < 0.2 and np.mean(error) < 0.05


def test_phrase_ends_are_those_of_the_parse():
    for text in (b"", b"a", b"aaaaaaa", b"abababab", bytes(random.Random(1).choices(b"ab", k=300))):
        ends = lz_fingerprint.phrase_ends(text)
        assert {text[a:b] for a, b in zip([0, *ends], ends, strict=False)} == _phrases(text)


def test_fingerprints_of_odd_rows(spark):
    out = lz_fingerprint.lz_fingerprints(odd(spark)).collect()
    assert len(out) == 7
    empty = [r for r in out if r["n_chars"] == 0]
    assert len(empty) == 3 and {r["fingerprint"] for r in empty} == {""} and max(r["near_edited"] for r in empty) == 1
    one = lz_fingerprint.lz_fingerprints(docs(spark, ["alone"])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"aloal").hexdigest()
    assert lz_fingerprint.lz_fingerprints(odd(spark).limit(0)).count() == 0


# 9. Mixing.


def _targets(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        level = rest / open_ if open_ else 0.0
        over = {s for s in names if s not in full and level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else level * weight[s] for s in names}
        full |= over


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), rng.choice(["a", "a", "a", "B", "é", None, "tiny"]) if i > 2 else "least") for i in range(3000)]
    out = mixing.entropy_mix(spark.createDataFrame(rows, f"{DOCS}, source string")).toPandas()
    out["key"] = out["source"].where(out["source"].notna(), None)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = _targets(dict(sizes))
    for source, group in out.groupby(out["key"].fillna("(null)")):
        source = None if source == "(null)" else source
        assert group["target"].iloc[0] == pytest.approx(want[source]) and group["source_size"].iloc[0] == sizes[source]
        assert abs(group["taken"].sum() - want[source]) <= max(10, 0.01 * want[source])
        free = group[(group["rate"] < 3) & (group["size"] > 0)]
        if len(free) > 10:  # one multiplier for each source
            assert np.ptp(np.log(free["rate"]) / free["size"]) < 1e-6
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] == out["copies"] * out["size"]).all()
    again = mixing.entropy_mix(spark.createDataFrame(rows, f"{DOCS}, source string").repartition(7)).toPandas()
    assert (out.set_index("doc_id")["taken"].sort_index() == again.set_index("doc_id")["taken"].sort_index()).all()


def test_mix_of_odd_rows(spark):
    out = mixing.entropy_mix(odd(spark)).collect()
    assert len(out) == 7 and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert mixing.entropy_mix(odd(spark).filter("doc_id < 2")).agg(F.sum("taken")).first()[0] == 0
    assert mixing.entropy_mix(odd(spark).limit(0)).count() == 0


# 10. Lines.


def test_line_windows_equal_brute_force(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(60)] + ["x\nx\nx\nx\nx", "", "\n\n\n\n"]
    seen, want = set(), []
    for t in texts:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if window in seen else set()
            seen.add(window)
        want.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    got = [(r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == want


def test_line_windows_of_odd_rows(spark):
    table = odd(spark)
    out = line_dedup.remove_repeated_windows(table)
    assert out.count() == 7 and set(out.columns) == set(table.columns) | {"n_removed"}
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] is None and got[0]["n_lines"] == 0 and got[1]["n_lines"] == 1 and got[4]["text"] == "one\ntwo\nthree"
    assert line_dedup.line_dedup(table.limit(0)).count() == 0


# The pipeline.


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "source_mixing"]
    start = table.unionByName(spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, None, None, None)], table.schema))
    first = corpus_pipeline.identify_language(spark, start, folder)
    assert first.columns == table.columns and first.count() == table.count()
    second = corpus_pipeline.dedup_lines(spark, table, folder)
    assert second.columns == table.columns and second.filter("n_chars <> char_length(text)").count() == 0 and second.count() == table.count()
    third = corpus_pipeline.join_near_copies(spark, table, folder)
    groups = {c for _, c in _components_of(table)}
    assert {r[0] for r in third.select("doc_id").collect()} == groups
    fourth = corpus_pipeline.remove_contaminated(spark, table, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    bad = {i for (i, _), c in zip(rows, _contamination([t for _, t in rows], items), strict=True) if c[-1]}
    assert {r[0] for r in fourth.select("doc_id").collect()} == {i for i, _ in rows} - bad and bad


def _components_of(table):
    rows = sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    out = ngram_join.ngram_jaccard_components(table).select("doc_id", "component_id").collect()
    assert len(out) == len(rows)
    return [tuple(r) for r in out]
