"""Cases in which an operator once did less than its whole job, against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import license_scan, mixing, ngram_join, pii
from tests.llm.test_llm import DOCS, _components, docs


# 3. N-gram join.


def _by_order(words):
    """Words by the global order of their n-grams of one word."""
    gram = {w: next(ngram_join._sets(pa.array([w]), 1))[2][0] for w in words}
    return sorted(words, key=gram.get)


def test_pair_that_meets_in_both_orientations(spark):
    """x (100 words) holds all of y (85): six shared first n-grams, half of them in columns that x's near
    copies fill and half in columns that y's fill, and no hub links the two."""
    order = _by_order([f"w{k}" for k in range(400)])
    own, f, s, high = order[:15], order[15:20], order[20:105], iter(order[105:])
    x, y = own + s, s
    texts = [x, y]
    p_high = [next(high) for _ in range(2)]
    for _ in range(6):
        texts.append([w for w in x if w not in (s[1], s[3], s[5])] + p_high + [next(high)])
    for _ in range(6):
        texts.append([w for w in y if w not in (s[0], s[2], s[4], s[9], s[10], s[84])] + f + [next(high)])
    texts = [" ".join(t) for t in texts]
    want = _components(texts, size=1)
    assert {c for _, c in want} == {0}
    got = [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs(spark, texts), size=1).orderBy("doc_id").collect()]
    assert got == want


def test_chained_near_copies_in_large_groups(spark):
    rng = random.Random(12)
    texts = []
    for g in range(3):
        words = [f"g{g}w{k}" for k in range(100)]
        for _ in range(80):
            kept = words[: rng.choice([85, 88, 92, 100])]
            for _ in range(rng.choice([0, 2, 4, 8])):
                kept[rng.randrange(len(kept))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(kept))
            if rng.random() < 0.2:
                words[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
    got = [(r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs(spark, texts), size=1).orderBy("doc_id").collect()]
    assert got == _components(texts, size=1)


# 2. Pseudonyms.


def test_a_phone_number_is_linked_however_it_is_written(spark):
    texts = ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+358 40 123 4567", "+358401234567", "+1 (826) 555-4081", "+18265554081", "v1.2.3.4 x_10.0.0.1", "at 10.0.0.1"]
    new = [r["text"] for r in pii.pseudonymize(docs(spark, texts), "k").orderBy("doc_id").collect()]
    plain = [re.sub("[^0-9]", "", x) for x in new]
    assert plain[0] == plain[1] == plain[2] and plain[3] == plain[4] and plain[5] == plain[6]
    assert [x[: len(c)] for x, c in zip(new, ["+44 ", "+44", "+44-", "+358 ", "+358", "+1 (", "+1"], strict=False)] == ["+44 ", "+44", "+44-", "+358 ", "+358", "+1 (", "+1"]
    assert all(re.sub("[0-9]", "9", a) == re.sub("[0-9]", "9", b) and a != b for a, b in zip(new[:7], texts, strict=False))
    assert new[7] == texts[7] and new[8] != texts[8]



def test_pseudonyms_of_neighbouring_numbers(spark):
    phone, ip, card = "+1 (826) 555-4081", "190.137.223.204", "4111111111111111"
    alone = [phone, ip, card, "4111 1111 1111 1111", "2024-02-29", "me@x.org", "4222222222222"]
    new = dict(zip(alone, (r["text"] for r in pii.pseudonymize(docs(spark, alone), "k").orderBy("doc_id").collect()), strict=True))
    assert all(a != b for a, b in new.items())
    rows = [
        (f"{phone} {ip}", [phone, ip]), (f"{phone} 12 apples", [phone]), (f"{card} 12/27", [card]), (f"{card} 123", [card]),
        (f"{card} {ip} {card}", [card, ip]), (f"12 {card} 7 {card} 34", [card]), ("1234 4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
        (f"{phone} {card}", [phone, card]), (f"{card} 2024-02-29", [card, "2024-02-29"]), (f"{card} me@x.org", [card, "me@x.org"]),
        ("2222222222222222222222 4222222222222-1", ["4222222222222"]), (f"{phone} 2024-02-29", [phone, "2024-02-29"]), ("12 34 56 " * 3000, []),
    ]
    got = pii.pseudonymize(docs(spark, [t for t, _ in rows]), "k").orderBy("doc_id").collect()
    for (text, inside), r in zip(rows[:-1], got, strict=False):
        want = text
        for value in inside:
            want = want.replace(value, new[value])
        assert r["text"] == want
        assert sum(r[f"n_{kind}"] for kind in pii.KINDS) == sum(text.count(v) for v in inside)
    assert re.sub("[0-9]", "9", got[-1]["text"]) == re.sub("[0-9]", "9", rows[-1][0])
    french = pii.pseudonymize(docs(spark, ["+33 6 12 34 56 78", "+44 20 7946 0958"]), "k").orderBy("doc_id").collect()
    assert [r["n_phone"] for r in french] == [1, 1] and not french[0]["text"].endswith(" 56 78")


# The pipeline.


def test_near_copies_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklm") + str(rng.randrange(90)) for _ in range(40)) for _ in range(12)]
    near = [t + " end" for t in texts]
    rows = [(1, texts[0]), (7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[2]), (None, near[2]), (3, texts[3]), (3, texts[3]), (3, near[3]), (None, texts[4]), (9, near[4]), (None, texts[5])]
    rows += [(None, None), (None, ""), (4, ""), (4, "")] + [(rng.choice([None, 5, 6, 20, 21]), rng.choice(texts[6:] + near[6:])) for _ in range(60)]
    table = spark.createDataFrame([(i, t, "s") for i, t in rows], f"{DOCS}, source string")
    out = corpus_pipeline.join_near_copies(spark, table, "")
    assert out.columns == table.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = defaultdict(list)
    for row, (n, c) in zip(rows, _components([t for _, t in rows]), strict=True):
        groups[c].append(row)
    key = lambda i: (i is None, i or 0)
    group_of = {t: c for c, group in groups.items() for _, t in group if t}
    kept = Counter(group_of[t] for _, t in got if t)
    assert kept == {c: 1 for c in set(group_of.values())} and not Counter(got) - Counter(rows)
    for i, t in got:
        assert not t or key(i) == min(key(k) for k, _ in groups[group_of[t]])
    assert Counter(r for r in got if not r[1]) == Counter(r for r in rows if not r[1])


# 9. Mixing.


@pytest.mark.parametrize("null_ids", [False, True])
def test_mix_of_sources_of_one_size(spark, null_ids):
    rows = [(None if null_ids else i, " ".join(["w"] * 10) if i % 3 else f"t{i} " + "w " * 9, "abcd"[i % 4] if i % 100 else "e") for i in range(4000)]
    rows += [(None if null_ids else 10**5 + i, "x " * 10, "a") for i in range(9000)]
    table = spark.createDataFrame(rows, f"{DOCS}, source string")
    out = mixing.entropy_mix(table).collect()
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    pick = lambda rows: Counter((r["doc_id"], r["source"], r["copies"]) for r in rows)
    assert pick(out) == pick(mixing.entropy_mix(table.repartition(5)).collect())


# 4. Licences.


def test_wrapped_notices_are_found():
    import textwrap

    background = ["The mill stood by the river and the miller slept.", "Prices of grain rose in the spring.", "She read the letter twice and put it away."] * 40
    model, templates = license_scan.train(background), license_scan._template_words()
    texts, want = [], []
    for family in ("mit", "bsd", "gpl-3.0", "apache-2.0"):
        notice = max(license_scan.TEMPLATES[family], key=len)
        for width in (40, 60, 76):
            for mark in ("", "# ", " * "):
                texts.append("\n".join(["Some prose first.", "", *(mark + x for x in textwrap.wrap(notice, width)), "", "More prose."]))
                want.append((2, family))
    texts += ["The mill\nstood by\nthe river.", "Permission is hereby granted\n\nfree of charge\n\nto any person", "Released under the\nMIT License."]
    got = [found for _, found in license_scan.scan_batch(model, templates, pa.array(texts))]
    assert [[(n, f) for n, f, _ in x] for x in got] == [[w] for w in want] + [[], [], [(0, "mit")]]
