"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import html
import itertools
import random
import re
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixeltide.llm import cells, decontaminate, langid, mincut, minhash, mixing, privacy, queries, repeats, tokencount, urlfilter
from pixeltide.llm.common import components

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "te", "vo") for b in ("ra", "li", "mon", "pu", "sten")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def docs_frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 1.0, "z") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, rate double, id string",
    )


def docs_folder(spark, docs):
    """A folder with docs as the table ``documents``."""
    folder = tempfile.mkdtemp(prefix="run-")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def copies(rng, rows, at):
    """Near copies of some texts: a few words changed, so that similarities lie on both sides of the threshold."""
    for i, t in list(rows):
        for k in range(3):
            w = (t or "").split(" ")
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(1000))
            rows.append((at + 10 * i + k, " ".join(w)))
    return rows


def test_minhash_matches_brute_force(spark):
    rng = random.Random(5)
    rows = copies(rng, [(i, prose(rng, rng.choice([3, 30, 60, 120, 400]))) for i in range(40)], 1000)
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "One two"), (5004, "one  TWO"), (5005, "É one"), (5006, "é one")]
    rows += [(6000, rows[3][1]), (7000, "a b c d e " * 3000), (7001, "a b c d e " * 2000)]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    groups = Groups(sets)
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            groups.join(a, b)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), groups.root(i), groups.root(i) == i) for i in sets
    }


def test_minhash_large_group_whose_first_member_links_few(spark, monkeypatch):
    """A chain of texts: neighbours link, most do not; several blocks, and no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    words = prose(rng, 300).split(" ")
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(300)] = "w" + str(rng.random())
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_frame(spark, rows)).collect()}
    groups = Groups(got)
    sets = {i: shingles(t) for i, t in rows}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            groups.join(a, b)
    assert got == {i: groups.root(i) for i in sets}


def test_minhash_repeated_and_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    rows = docs_frame(spark, [(1, text), (1, text), (None, text), (2, text), (3, "x"), (3, "y"), (4, "y")])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 3, False)]
    assert minhash.near_duplicates(rows.filter("false")).collect() == []


def test_low_bit_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    for shared in (500, 1000, 1600):
        a = np.unique(base[:1800])
        b = np.unique(np.r_[base[1800 - shared : 1800], rng.integers(0, 1 << 62, 1800 - shared).astype(np.uint64)])
        true = shared / (3600 - shared)
        sig = minhash.pack_low_bits(minhash.minima([a, b]))
        assert abs(minhash.similarity(sig[0], sig[1]) - true) < 0.2


def test_components_of_a_chain_a_star_and_a_loop(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 201), (201, 302), (302, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + k: 100 for k in range(30)}, 201: 201, 300: 201, 302: 201}


def expected_repeats(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("crowd", [1, 2048])
def test_repeats_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "STEP_BYTES", 700)
    rng = random.Random(9)
    passage, second = prose(rng, 60), prose(rng, 40)
    texts = [prose(rng, rng.randrange(120)) for _ in range(20)]
    texts += [prose(rng, 20) + passage + prose(rng, 15) for _ in range(6)] + [passage[30:350], second[:200], prose(rng, 9) + second[1:180] + "é"]
    texts += ["ab" * 300, "x" * 500, "", None, passage, texts[3], texts[3], "same line\n" * 60]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, passage), (None, passage)]
    got = repeats.drop_repeats(docs_frame(spark, rows), length=128).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, gone in zip(rows, raw, expected_repeats(raw, 128), strict=True):
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(i), bytes(b for b, g in zip(t, gone, strict=True) if not g), len(t), sum(gone), spans))
    assert sorted((str(r.doc_id), bytes(r.kept_bytes), r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted(want)


def test_interval_expansion_against_counting():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice([3, 5, 8])
        texts = [bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcd") for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 6))]
        weights = np.array([rng.choice([1, 1, 2]) for _ in texts], float)
        seen = Counter()
        for t, w in zip(texts, weights, strict=True):
            for k in range(len(t) - length + 1):
                seen[t[k : k + length]] += w
        got = repeats.repeated_starts([np.frombuffer(t, np.uint8) for t in texts], weights, length)
        assert [list(g) for g in got] == [[seen[t[k : k + length]] >= 2 for k in range(len(t) - length + 1)] for t in texts]


def plain_tiles(doc, item, shortest):
    """Greedy tiling by the plain rule: mark a longest unmarked common run, again and again."""
    used_doc, used_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for t, p in itertools.product(range(len(doc)), range(len(item))):
            k = 0
            while t + k < len(doc) and p + k < len(item) and doc[t + k] == item[p + k] and not used_doc[t + k] and not used_item[p + k]:
                k += 1
            best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < shortest:
            return covered
        used_doc[t : t + k] = [True] * k
        used_item[p : p + k] = [True] * k
        covered += k


def test_tiles_cover_what_the_plain_rule_covers():
    rng = random.Random(2)
    for _ in range(80):
        item = [rng.randrange(30) for _ in range(rng.randrange(5, 40))]
        cut = rng.randrange(len(item))
        doc = [rng.randrange(30) for _ in range(10)] + item[cut:] + [99] + item[:cut] + item[: cut // 2]
        assert decontaminate.tile(doc, item, 3) == plain_tiles(doc, item, 3)


def test_decontamination_catches_reordered_passages_and_leaves_the_rest(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 30)) for k in range(6)] + [(7, "too short here"), (8, None), (9, "")]
    third = items[2][1].split(" ")
    texts = [
        prose(rng, 50) + " " + items[0][1].upper() + " " + prose(rng, 50),
        " ".join(third[20:] + ["-"] + third[:10] + ["..."] + third[10:20]),
        " ".join(third[:10]) + prose(rng, 200),
        prose(rng, 3000),
        "too short here",
        None,
        "",
        (items[4][1] + " ") * 2,
    ]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, items[5][1])]
    docs, bench = docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.n_covered, r.n_tokens) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted([("0", 0, 30, 30), ("0", 0, 30, 30), ("1", 2, 30, 30), ("7", 4, 30, 30), ("None", 5, 30, 30)])
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.matches(docs, bench.filter("false")).collect() == []
    assert decontaminate.matches(docs.filter("false"), bench).collect() == []


def test_seeds_that_only_look_alike_find_nothing(monkeypatch):
    monkeypatch.setattr(decontaminate, "_FILTER_BITS", 1)
    rng = random.Random(8)
    block = decontaminate.Block.of([1], [prose(rng, 30)])
    for _, words, first in decontaminate.tokens(pa.array([prose(rng, 50), "", prose(rng, 9)])):
        assert block.candidates(words, first) == {}


def test_decontamination_in_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, 30)) for k in range(12)]
    docs, bench = docs_frame(spark, [(k, prose(rng, 9) + " " + t) for k, t in items]), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()) == [(k, k) for k in range(12)]
    assert decontaminate.decontaminate(docs, bench).count() == 0


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, rep string")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_match_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(cells, "BLOCK", 32)
    monkeypatch.setattr(cells, "PER_CELL", 40)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 32))
    many = np.concatenate([base, base[rng.integers(0, 60, 150)] + 0.12 * rng.normal(size=(150, 32)), np.repeat(base[:1], 50, axis=0), 3 * base[1:5]])
    many = many.astype(np.float32).astype(float)
    rows = [(i, [float(x) for x in v], 0, "r") for i, v in enumerate(many)]
    odd = [(900, None, 0, "r"), (901, [0.0] * 32, 0, "r"), (902, [float("nan")] * 32, 0, "r"), (903, [None] + [1.0] * 31, 0, "r")]
    odd += [(904, [float("inf")] * 32, 0, "r"), (905, [], 0, "r"), (906, [1.0, 2.0], 0, "r"), (907, [2.0, 4.0], 0, "r"), (None, rows[0][1], 0, "r")]
    got = {r.vec_id: r for r in cells.near_vectors(vectors_of(spark, rows + odd, kind)).collect()}
    unit = many / np.linalg.norm(many, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    groups = Groups(range(len(many)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        groups.join(int(a), int(b))
    for i in range(len(many)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), groups.root(i), groups.root(i) == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903, 904, 905))
    assert got[906].n_links == got[907].n_links == 1 and got[907].component_id == 906
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert cells.near_vectors(vectors_of(spark, [], kind)).collect() == []


def test_vectors_with_uneven_dimensions_link_from_both_ends(spark, monkeypatch):
    monkeypatch.setattr(cells, "PER_CELL", 16)
    rng = np.random.default_rng(12)
    spread = 1 / np.arange(1, 17) ** 2
    base = rng.normal(size=(400, 16)) * spread
    many = np.concatenate([base, base + 0.3 * rng.normal(size=(400, 16)) * spread])
    got = {r.vec_id: r.n_links for r in cells.near_vectors(vectors_of(spark, [(i, v.tolist(), 0, "r") for i, v in enumerate(many)], "double")).collect()}
    unit = many / np.linalg.norm(many, axis=1, keepdims=True)
    assert [got[i] for i in range(len(many))] == ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()


def test_language_of_mixed_texts(spark):
    rng = random.Random(1)
    parts = {"aa": ["tion", "the", "ing", "and"], "bb": ["chen", "ung", "sch", "ei"], "cc": ["ов", "ени", "пр", "ст"]}
    word = lambda k: "".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    train = [(i, text("aabbcc"[i % 3 * 2 : i % 3 * 2 + 2], 80), "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2]) for i in range(90)]
    model = langid.learn(spark.createDataFrame(train + [(500, None, "aa"), (501, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    a, b, c = text("aa", 30), text("bb", 12), text("cc", 20)
    tests = [(1, a), (2, f"{a} {b} {c}"), (3, None), (4, "123 !? \n"), (5, ""), (6, "İ" + c), (7, text("bb", 30_000))]
    frame = spark.createDataFrame([(i, t, "old", 0.5) for i, t in tests], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    assert got[1].lang_pred == "aa" and got[1].score == 1.0
    assert [s.lang for s in got[2].spans] == ["aa", "bb", "cc"] and got[2].lang_pred == "aa"
    full = tests[1][1]
    assert [full[s.begin : s.end] for s in got[2].spans] == [a, b, c]
    assert all((got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, []) for i in (3, 4, 5))
    assert got[6].lang_pred == "cc" and got[7].lang_pred == "bb"
    empty = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(frame, empty).collect()} == {"und"}


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    sizes = np.array([6, 4, 1])
    scores = rng.normal(size=(11, 3)) * 3
    got = langid.viterbi(scores, sizes, 2.0)
    at = 0
    for n in sizes:
        own = scores[at : at + n]
        value = lambda path, own=own, n=n: sum(own[k, path[k]] for k in range(n)) - 2.0 * sum(path[k] != path[k - 1] for k in range(1, n))
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(tuple(got[at : at + n])) == pytest.approx(value(best))
        at += n


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out("doc_id"))
    found = langid.identify(docs, langid.learn(docs.filter("not held_out"))).filter("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


def test_token_histogram_answers_every_limit(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 5, 40, 700])) for _ in range(60)] + [None, "", "x" * 20_000, "é\u200b😀"]
    lengths = tokencount.encoded_lengths(docs_frame(spark, list(enumerate(texts))), keep=("doc_id",))
    counts = {r.doc_id: r.n_tokens for r in lengths.collect()}
    encode = tokencount.encoder(tokencount.VOCABULARY)
    assert counts == {i: len(encode.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert all(encode.decode(encode.encode_ordinary(t)) == t for t in texts if t)
    sizes = sorted(counts.values())
    hist = tokencount.length_histogram(lengths).cache()
    for r in hist.collect():
        assert r.n_docs == sizes.count(r.n_tokens) and r.docs_total == len(sizes) and r.tokens_total == sum(sizes)
        assert r.docs_at_least == sum(s >= r.n_tokens for s in sizes) and r.tokens_at_least == sum(s for s in sizes if s >= r.n_tokens)
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
    for limit in (0, 1, 17, 500, 10**6):
        assert tuple(tokencount.truncated_total(hist, limit).first()) == (sum(min(s, limit) for s in sizes), sum(s > limit for s in sizes))
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = next(s for s in sizes if sum(x <= s for x in sizes) >= np.ceil(q * len(sizes)))
        assert tokencount.quantile(hist, q).first()[0] == want
    assert tokencount.length_histogram(lengths.filter("false")).collect() == []


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


HARD = [
    "a@b.c_d@e.f g@h.i", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1111-1", "+1 (377) 555-0100 +49 170 1234567. +1 2",
    "é😀 a@b.co 😀 10.0.0.1", "@@a@b.c@d.e", "a" * 30_000 + "@b." + "c." * 5000 + "d", "1" * 20_000 + " 2 " * 9000, "+" * 5000 + "1", "", None, "ß" * 10 + "x@y.z",
]


def test_personal_data_matches_plain_search(spark):
    rows = list(enumerate(HARD)) + [(0, HARD[0]), (None, HARD[4])]
    for r in privacy.report(docs_frame(spark, rows)).collect():
        want = plain_spans(HARD[4 if r.doc_id is None else r.doc_id])
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
    assert privacy.report(docs_frame(spark, [])).collect() == []


def test_terms_that_reveal_an_entity_are_found_and_replaced(spark):
    rng = random.Random(6)
    plain = [(i, prose(rng, 60)) for i in range(60)]
    told = [(100 + k, f"{prose(rng, 12)} meet Zorblax {prose(rng, 2)} at ann@corp.example {rng.choice(WORDS)} {prose(rng, 12)}") for k in range(8)]
    docs = docs_frame(spark, plain + told + [(200, "the word Zorblax alone, far from any address"), (201, None)])
    spans = {r.doc_id: r.spans for r in privacy.report(docs).collect()}
    terms = {i: [dict(told)[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in spans[i].split(",")) if k == "term"] for i in dict(told)}
    # The name stands once without the address, so it tells a little less than all of it.
    assert all("Zorblax" in t for t in terms.values())
    assert not any(spans[i] for i, _ in plain)
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert all(clean[i] == t for i, t in plain) and clean[201] is None and "Zorblax" in clean[200]
    assert all("[EMAIL]" in clean[i] and "[TERM]" in clean[i] and "Zorblax" not in clean[i] and "@" not in clean[i] for i in dict(told))


def test_revealing_terms_go_from_every_text(spark):
    """Far from the address, in texts without it, in any case, and in rows with null or repeated ids."""
    rng = random.Random(6)
    plain = [(i, prose(rng, 60)) for i in range(160)]
    told = [(1000 + k, f"{prose(rng, 90)} meet Zorblax {prose(rng, 2)} at ann@corp.example {rng.choice(WORDS)} {prose(rng, 12)}") for k in range(8)]
    told[0] = (100_000, "Zorblax " + told[0][1])
    other = "\u0130 the word ZORBLAX alone, not zorblaxes or Zor"
    docs = docs_frame(spark, plain + told + [(2000, other), (None, other), (2001, None)])
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs, everywhere=True).collect()}
    assert clean[2000] == clean[None] == "\u0130 the word [TERM] alone, not zorblaxes or Zor"
    assert not any("Zorblax" in clean[i] for i, _ in told) and all(clean[i] == t for i, t in plain) and clean[2001] is None
    spans = {r.doc_id: (r.n_term, r.spans) for r in privacy.report(docs, everywhere=True).collect()}
    assert spans[2000] == spans[None] == (1, "term:11:18") and all(spans[i][1].count("term:") == spans[i][0] >= 2 for i, _ in told)
    query = {r.doc_id: r.spans for r in queries.op6_privacy(spark, docs_folder(spark, docs)).collect()}
    assert query == {i: s for i, (_, s) in spans.items()}


def test_terms_far_from_an_entity_or_of_one_mentioned_twice_are_found(spark):
    rng = random.Random(16)
    plain = [(i, prose(rng, 60)) for i in range(900)]
    far = [(1000 + k, f"Zorblax {prose(rng, 90)} ann@corp.example {prose(rng, 30)}") for k in range(8)]
    twice = [(2000 + k, f"{prose(rng, 30)} Quixby {prose(rng, 30)} {prose(rng, 5)} bob@corp.example") for k in range(2)]
    # One text and its copies are one piece of evidence.
    once = f"Wimbly {prose(rng, 40)} carl@corp.example"
    docs = docs_frame(spark, plain + far + twice + [(3000, once), (3001, once), (3001, once), (4000, None)])
    found = privacy.detected(docs)
    pairs = {(r.entity, r.term) for r in privacy.disclosing(found, docs).collect()}
    assert pairs == {("email:ann@corp.example", "zorblax"), ("email:bob@corp.example", "quixby")}


def test_overlapping_spans_are_replaced_once(spark):
    rows = [(1, "call +49 10.20.30.40 now"), (2, "x 4111 1111 1111 1111 y a@b.co"), (3, "none"), (None, "a@b.co")]
    got = {r.doc_id: r.text for r in privacy.sanitised(docs_frame(spark, rows)).collect()}
    assert got == {1: "call [PHONE] now", 2: "x [CARD] y [EMAIL]", 3: "none", None: "[EMAIL]"}


URLS = [
    "http://WWW.Example.com/en/x", "http://example.com/en/y?a=1", "https://a.b.net/es/1", "http://net/es/", "http://xnet/es/", "http://q.com/", "http://q.com",
    "ftp://h.org/p//q?x=1&y=2#z", "no scheme at all", "://", None, "", "http://h.net?x/es/", "http://example.com.net/fr/#f", "x://y://net/fr/", "http://É.com/Ö",
]


def plain_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_match_plain_code(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    for r in urlfilter.judged_urls(pages).collect():
        host, path, rule, verdict = plain_verdict(URLS[r.page_id % len(URLS)])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urlfilter.judged_urls(pages.filter("false")).collect() == []


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(3)
    bad = lambda: f"http://x{rng.randrange(10**6)}-win.example{rng.randrange(9)}.zz/{rng.randrange(10**9)}?a=1&b={rng.randrange(999)}&c=3"
    good = lambda: f"https://www.{rng.choice(WORDS)}.example.org/{rng.choice(WORDS)}/{rng.choice(WORDS)}.html"
    labelled = spark.createDataFrame([(bad(), 1) for _ in range(150)] + [(good(), 0) for _ in range(150)], "url string, label int")
    fresh = [(i, bad() if i % 2 else good()) for i in range(100)]
    got = urlfilter.judged_urls(spark.createDataFrame(fresh, "page_id long, url string"), rules=(), labelled=labelled).collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 97


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><script>var a="</p><p>no";</script><div id="cookie-banner">We use cookies. <a href=x>ok</a></div>
<header><h1>Site</h1><a href=/>Home</a></header><div class="wrap"><div class="story"><h2>Title &lt;here&gt;</h2><p>First  paragraph, with a sentence<br>that goes on.
<p>Second &amp; last&nbsp;one, of <b>several <i>words</b>.<ul><li>An item<li>Another item</ul></div><div class="sidebar"><ul><li><a href=1>Rel</a></ul></div>
<section id="comments"><h3>Comments</h3><p>I like this a lot, it is a long comment.</p></section></div><form><label>Name</label><input></form><footer>(c)</footer></body>"""


def test_main_text_of_a_page():
    want = ["Title <here>", "First paragraph, with a sentence that goes on.", "Second & last one, of several words.", "An item", "Another item"]
    assert mincut.main_text(PAGE, mincut._PRIOR) == "\n".join(want)


def test_pages_of_the_table_and_odd_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = ["", None, "<", "<p", "<!-- open", "plain words only, and a full sentence of them.", "<script>x", "<div " * 3000, "</p></div>" * 2000, "<b>" * 20_000 + "deep" + "<p>" * 3000]
    rows = pages.select("page_id", "url", "html").union(spark.createDataFrame([(10_000 + i, None, h) for i, h in enumerate(odd)], pages.schema))
    got = {r.page_id: r.text for r in mincut.main_texts(rows.withColumn("text", F.lit("old")), keep=["page_id", "text"]).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>|</?article>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
    assert got[10_000] == got[10_001] == got[10_006] == "" and got[10_005] == odd[5]


def test_minimum_cut_against_all_cuts():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 8)
        content, other = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        edges = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda side: sum(other[i] if side[i] else content[i] for i in range(n)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])  # noqa: B023, E731
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(mincut.min_cut(content, other, edges)) == pytest.approx(best)


def test_rates_meet_the_targets(spark):
    rng = random.Random(1)
    bad = ["vile", "trash", "idiot", "awful"]
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        words = prose(rng, rng.randrange(20, 200)).split(" ")
        words = [w + "###" for w in words] if kind == 1 else [rng.choice(bad) if rng.random() < 0.2 else w for w in words] if kind == 2 else words
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind == 0), int(kind == 2)))
    rows += [(900, None), (901, ""), (0, rows[0][1]), (None, rows[1][1])]
    labels = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mixture(docs_frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and min(r.rate for r in out) >= 0 and all(abs(sum(r.shares) - 1) < 1e-9 for r in out)
    total = sum(r.n_tokens for r in out)
    for k, d in enumerate(mixing.DOMAINS):
        assert sum(r.rate * r.n_tokens * r.shares[k] for r in out) == pytest.approx(mixing.TARGETS[d] * total, abs=2e-6 * total)
    held = [r for r in out if r.doc_id is not None and r.doc_id % 2 == 0 and r.doc_id < 300]
    assert sum(int(np.argmax(r.shares)) == r.doc_id % 3 for r in held) >= 0.9 * len(held)
    assert {r.n_tokens for r in out if r.doc_id in (900, 901)} == {0}
    none = mixing.mixture(docs_frame(spark, rows), labels.filter("false")).collect()
    assert {round(s, 6) for r in none for s in r.shares} == {round(1 / 3, 6)}
    assert mixing.mixture(docs_frame(spark, []), labels).collect() == []


def test_pipeline_stages_take_effect(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    item = spark.read.parquet(f"{source}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    text = docs.filter(F.length("text") > 1500).first().text
    extra = [(90_001, "12 34 !!"), (90_002, text + " tail"), (90_003, text), (90_004, f"The the and {item}"), (90_005, "The the and of to them. Write to ann@corp.example now."), (90_006, None)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], docs.schema)
    docs.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    stages, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        stages[name] = {r.doc_id: r.text for r in now.collect()}
    before = {r.doc_id for r in docs.collect()} | {i for i, _ in extra}
    # Every document of the table has letters of a known language.
    assert before - set(stages["language"]) == {90_001, 90_006}
    sets = {i: shingles(t) for i, t in stages["language"].items()}
    groups = Groups(sets)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            groups.join(a, b)
    assert set(stages["near duplicates"]) == {groups.root(i) for i in sets}
    assert 90_004 in stages["near duplicates"] and 90_004 not in stages["benchmarks"]
    assert "[EMAIL]" in stages["personal data"][90_005] and "@" not in stages["personal data"][90_005]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in final) == sorted(stages["personal data"])
    assert defaultdict(int, Counter(r.doc_id for r in final)).get(90_003, 0) == 0 and all(r.rate >= 0 for r in final)
