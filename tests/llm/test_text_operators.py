"""Operators on documents against brute force on small tables, with the awkward cases of each."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from tessella.llm import packing, pieces, pii, quality, rules, simhash, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, spans string, n int"


def table(spark, texts):
    """Documents of (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, 0.5, "x", 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = [r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrst") + str(k % 7) * (k % 5 == 0) for k in range(300)]
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, other = words(60), words(25)
    out = [(i, words(r.randrange(5, 120)) + ("\n" if i % 4 else " ") + (passage if i % 5 == 0 else "") + " " + (other if i % 3 == 0 else "")) for i in range(60)]
    out += [(60 + i, out[i][1]) for i in range(8)]
    out += [(70, None), (71, ""), (72, " \t\n "), (73, "one"), (74, "the " * 300), (75, "é ü \x1c日本 a\x85b"), (76, words(20)), (77, words(19)), (78, "ab cd " * 30 + passage)]
    out += [(79, words(6000)), (80, out[3][1].upper()), (3, out[3][1]), (81, out[7][1] + " tail")]
    return out


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_substring(spark, texts):
    got = by_id(substring.deduplicate(table(spark, texts).repartition(5)))
    seen = set()
    for i, t in sorted({i: t for i, t in texts}.items()):
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone |= set(range(p, p + 20))
            seen.add(key)
        kept = [x for k, x in enumerate(w) if k not in gone]
        row = got[i]
        assert (row.n_words, row.n_removed, row.kept_sha256) == (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()), i


def test_substring_stage(spark, texts):
    docs = table(spark, texts)
    out = by_id(substring.without_repeats(docs))
    counts = by_id(substring.deduplicate(docs))
    assert out[73].text == "one" and out[70].text is None and out[72].text == " \t\n "
    for i, row in out.items():
        assert len(WORD.findall(row.text or "")) == counts[i].n_words - counts[i].n_removed
        assert row.n_chars == len(row.text or "")
    assert substring.without_repeats(docs).columns == docs.columns


def test_substring_null_ids(spark):
    same = " ".join(f"w{i}" for i in range(40))
    got = substring.deduplicate(table(spark, [(None, same), (1, same), (2, same)])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {None: 0, 1: 0, 2: 40}


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    got = by_id(simhash.simhash_components(table(spark, texts).repartition(3)))
    prints = {i: brute_fingerprint(t) for i, t in texts}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_simhash_links_in_large_groups():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, r.integers(0, 3), replace=False))) for b in base for _ in range(60)]
    values = np.unique(np.array(near, dtype=np.uint64))
    found = simhash.tile_links(values)
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in found:
        assert (a ^ b).bit_count() <= 3 and find(a) != find(b)
        root[find(a)] = find(b)
    for i, a in enumerate(values):
        close = values[np.bitwise_count(values ^ a) <= 3]
        assert len({find(int(v)) for v in close}) == 1
    assert len(found) < len(values)


def test_simhash_tiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    r = random.Random(3)
    base = r.getrandbits(64)
    prints = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)} | {r.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(p - (1 << 64) * (p >> 63),) for p in prints], "fp long")
    links = {(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.fingerprint_links(df).collect()}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        root[find(a)] = find(b)
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_rules_base_counts(spark, texts):
    got = by_id(rules.judge(table(spark, texts)))
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        places = {}
        for p in range(len(w) - 2):
            places.setdefault(tuple(w[p : p + 3]), []).append(p)
        covered = {p + k for ps in places.values() if len(ps) > 1 for p in ps for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        row = got[i]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == want, i
        assert not (row.base_failed and row.kept)


def test_rules_tell_defects_from_prose():
    prose, symbols, shouts, odd = (0,) * 5 + (1,) * 4, (-1, -1, 0, 0, 0, 1, 1, 1, 1), (0, -1, -1, 0, 0, 1, 1, 1, 1), (0, 0, 0, 0, -1, 1, 1, 1, 1)
    prior, weights = rules.fit([(prose, 850), (symbols, 80), (shouts, 60), (odd, 10)])
    odds = [rules.log_odds(v, prior, weights) for v in (prose, symbols, shouts)]
    assert odds[0] > 0 > max(odds[1:])
    assert rules.fit([])[1] == []


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns():
    r = random.Random(4)
    samples = ["a@b.c_d@e.f x@@y.z", "1.2.3.4.5.6.7.8.9 300.1.1.1 001.02.3.4", "4111 1111 1111 1111", "+1 (415) 555-0134.", "é+49 30 1234567, a.b@c.d-e.fg"]
    samples += ["".join(r.choice("a1b2.@+- ()9\né4") for _ in range(r.randrange(80))) for _ in range(3000)]
    for text in samples:
        raw = text.encode()
        assert pii.to_points(raw, pii.base_spans(raw)) == brute_spans(text), text


def test_pii_query(spark, texts):
    rows = [*texts, (90, "Call (415) 555-2671 or +1 415 555 2671; mail bob.jones [at] corp [dot] com, é 10.0.0.1"), (91, "in 1999 about 250 people"), (92, "9" * 50_000 + " " + "a" * 200_000 + "@")]
    got = by_id(pii.find(table(spark, rows)))
    for i, t in rows:
        base = brute_spans(t or "") if i != 92 else []
        assert got[i].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(pii.written(base).split(",")) <= set(got[i].spans.split(",")) or not base
    assert "phone:5:19" in got[90].spans and "email:45:74" in got[90].spans
    assert got[91].spans == "" == got[70].spans


def test_pii_field_learns_and_decodes_exactly():
    field = pii.train()
    for tokens, tags in pii.examples():
        assert field.decode(field.emissions(tokens)[None])[0].tolist() == tags
    import itertools

    emissions = np.random.default_rng(2).normal(size=(1, 4, len(pii.TAGS))) * 3
    ok = lambda s, t: t == 0 or pii.TAGS[t][0] == "B" or (s and pii.TAGS[s][1:] == pii.TAGS[t][1:])
    best = max(
        (p for p in itertools.product(range(9), repeat=4) if ok(0, p[0]) and all(map(ok, p, p[1:]))),
        key=lambda p: sum(emissions[0, i, t] for i, t in enumerate(p)) + sum(field.steps[a, b] for a, b in zip(p, p[1:])),
    )
    assert field.decode(emissions)[0].tolist() == list(best)


def test_pii_mask(spark):
    docs = table(spark, [(1, "to a@b.c or 4111 1111 1111 1111!"), (2, None), (3, "")])
    out = by_id(pii.masked(docs))
    assert [out[i].text for i in (1, 2, 3)] == ["to [EMAIL] or [CARD]!", None, ""] and out[1].n_chars == 21
    assert pii.masked(docs).columns == docs.columns


def test_pieces_match_the_library(spark, texts):
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = pieces.Pieces(open(pieces.MODEL, "rb").read())
    r = random.Random(6)
    samples = ["".join(r.choice("aeiostthing  \n▁é日本x.,\"the and") for _ in range(r.randrange(70))) for _ in range(1500)]
    samples += ["  a\nb  ", "", " ", "\n", "　a", "x" * 3000, "wörter " * 50]
    for text, ids in zip(samples, own.encode(samples)):
        assert np.frombuffer(ids, "<i4").tolist() == reader.encode(text), text
        assert own.decode(ids).decode() == text.replace("▁", " ")
    rows = by_id(pieces.encode(table(spark, texts)))
    for i, t in texts:
        assert rows[i].ids == reader.encode(t or "") and rows[i].n_pieces == len(rows[i].ids) and rows[i].round_trip
    back = by_id(pieces.decode(pieces.encode(table(spark, texts))))
    assert all(back[i].text == (t or "") for i, t in texts)


def test_pieces_runs_of_marks_are_quick():
    import time

    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    own = pieces.Pieces(open(pieces.MODEL, "rb").read())
    r = random.Random(16)
    samples = [" " * k + x for k in (3, 20, 25, 40, 333, 1000) for x in ("", "word", "\n", "  x")] + ["".join(r.choice(" \n▁a") for _ in range(400)) for _ in range(50)]
    for text, ids in zip(samples, own.encode(samples)):
        assert np.frombuffer(ids, "<i4").tolist() == reader.encode(text), text
    began = time.process_time()
    many = own.encode([" " * 1_000_000 + "end"])[0]
    assert time.process_time() - began < 30 and own.decode(many) == b" " * 1_000_000 + b"end"


def test_pieces_memory_is_bounded(monkeypatch):
    own = pieces.Pieces(open(pieces.MODEL, "rb").read())
    monkeypatch.setattr(pieces, "WORD_BYTES", 20_000)
    monkeypatch.setattr(pieces, "PAIR_BYTES", 20_000)
    r = random.Random(17)
    fresh = pieces.Pieces(open(pieces.MODEL, "rb").read())
    for _ in range(30):
        text = " ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(60))
        assert own.encode([text]) == fresh.encode([text])
        assert len(own.words) < 400 and len(own.beside) <= 20_000 // pieces.ENTRY + 1


def test_packing_against_a_plain_search(spark, texts):
    r = random.Random(7)
    items = [(i, r.choice([0, 3, 40, 90, 100, 130, 250, 999]), r.choice(["a", "b", None]), r.choice([1, 2, i + 10, None])) for i in range(300)]
    bins = packing.pack_shard(items, capacity=200, per_source=2)
    source, cluster, size = ({x[0]: x[k] for x in items} for k in (2, 3, 1))
    left = [(x[2], x[1] % 200) for x in items if x[1] % 200]
    limit = {s: max(2, math.ceil(2 * sum(y == s for y, _ in left) / len(left) * 200 / (sum(n for _, n in left) / len(left)))) for s in "ab"}
    plain: list = [[(x[0], k * 200, 200)] for x in items for k in range(x[1] // 200)]
    for n, start, doc in sorted(((n % 200, n // 200 * 200, d) for d, n, _, _ in items if n % 200), key=lambda x: (-x[0], x[2])):
        fits = []
        for at, b in enumerate(plain):
            room = 200 - sum(k for _, _, k in b)
            clash = cluster[doc] is not None and any(cluster[d] == cluster[doc] for d, _, _ in b)
            clash |= source[doc] is not None and sum(source[d] == source[doc] for d, _, _ in b) >= limit[source[doc]]
            if room >= n and not clash:
                fits.append((room, at))
        if fits:
            plain[min(fits)[1]].append((doc, start, n))
        else:
            plain.append([(doc, start, n)])
    assert bins == plain
    assert {d: s for d, s in size.items() if s} == {d: sum(k for b in bins for x, _, k in b if x == d) for d, s in size.items() if s}


def test_packing_query_loses_nothing(spark, texts):
    rows = packing.pack(table(spark, texts), capacity=100, shard_docs=20).collect()
    got: dict = {}
    for row in rows:
        assert row.n_words == sum(row.lengths) <= 100 and (row.bin_id is None) == (row.n_words == 0)
        for d, a, n in zip(row.doc_ids, row.starts, row.lengths):
            got.setdefault(d, []).append((a, n))
    for i, t in texts:
        n = len((t or "").encode().split()) * sum(j == i for j, _ in texts)
        assert sum(k for _, k in got[i]) == n
    assert len({r.bin_id for r in rows if r.bin_id is not None}) == sum(r.bin_id is not None for r in rows)


def test_packing_fills_bins_of_one_source():
    r = random.Random(19)
    bins = packing.pack_shard([(i, r.randrange(50, 100), "only", i) for i in range(4000)])
    assert sum(n for b in bins for _, _, n in b) > 0.95 * packing.CAPACITY * (len(bins) - 1)


def test_packing_deals_repeats_apart(spark):
    rows = spark.range(12_000).selectExpr("if(id < 6000, 7, id) as doc_id", "if(id < 6000, 'one two three', concat('w ', id)) as text", "'s' as source").repartition(5)
    got = packing.pack(rows, shard_docs=300).collect()
    of_shard: dict = {}
    for x in got:
        of_shard[x.bin_id >> 32] = of_shard.get(x.bin_id >> 32, 0) + len(x.doc_ids)
        assert x.doc_ids.count(7) <= 1
    assert sum(of_shard.values()) == 12_000 and len(of_shard) == 40 and max(of_shard.values()) < 450


def test_packing_by_given_clusters(spark):
    rows = spark.createDataFrame([(i, f"w{i} " * 5, "s", i % 3) for i in range(30)], "doc_id long, text string, source string, component_id long")
    got = packing.pack(rows, capacity=100, cluster_col="component_id").collect()
    assert all(len({d % 3 for d in x.doc_ids}) == len(x.doc_ids) for x in got) and sum(len(x.doc_ids) for x in got) == 30


def labels_of(spark, rows, column):
    return spark.createDataFrame([(i, y) for i, y in rows], f"doc_id long, {column} int")


def test_toxicity_finds_variants(spark):
    r = random.Random(8)
    vocabulary = [r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrst") + r.choice(["a", "en", "is"]) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(vocabulary) for _ in range(r.randrange(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(len(w))] = "zork" + r.choice(["a", "en", "is", "uf", "oto"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 100_000)]
    got = by_id(toxicity.classify(table(spark, rows), labels_of(spark, [*labels, (5000, 1), (None, 0), (1001, None)], "toxic")))
    import zlib

    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got.values())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert got[1000].predicted == got[1001].predicted == 0
    kept = toxicity.keep_ordinary(table(spark, rows), labels_of(spark, labels, "toxic"))
    assert kept.columns == table(spark, rows).columns and {x.doc_id for x in kept.collect()} >= {1000, 1001}


def brute_letters(counts, order):
    """Kneser-Ney by the definition: counts of n-grams as (ordinary, toxic), to a function that scores a word."""
    ones, twos = (sum(o + t == k for o, t in counts.values()) for k in (1, 2))
    d = min(0.95, max(0.3, ones / max(1, ones + 2 * twos)))
    followed: dict = {}
    for g in counts:
        if len(g) > 1:
            followed[g[1:]] = followed.get(g[1:], 0) + 1

    def shared(g):
        if not g:
            return 1 / 256
        same = [n for h, n in followed.items() if len(h) == len(g) and h[:-1] == g[:-1]]
        return (max(followed.get(g, 0) - d, 0) + d * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:])

    top = {g: c for g, c in counts.items() if len(g) == order or g[:1] == b"\x02"}

    def letter(g):
        after = [c for h, c in top.items() if len(h) == len(g) and h[:-1] == g[:-1]]
        if not after:
            return 0.0
        p = []
        for k in (0, 1):
            total, weight = sum(c[k] for c in after), 1.0
            if total:
                weight = d * sum(c[k] > 0 for c in after) / total
            p.append((max(top[g][k] - d, 0) / total if total and g in top else 0.0) + weight * (shared(g[1:]) if g in top else 1.0))
        return math.log(p[1] / p[0])

    def word(w):
        """Per letter, as a whole, up to the best letter."""
        s = b"\x02" + w + b"\x03"
        values = [letter(s[max(0, i - order) : i]) for i in range(2, len(s) + 1)]
        if len(values) <= 16:
            return sum(values) / len(values), sum(values), max(sum(values[:i]) for i in range(len(values) + 1))
        return max(sum(values[i : i + 16]) / 16 for i in range(len(values) - 15)), 0, 0

    return word


def counts_of(words, order):
    out: dict = {}
    for w, y in words:
        s = b"\x02" + w + b"\x03"
        for i in range(2, len(s) + 1):
            for n in range(1, min(order, i) + 1):
                c = out.setdefault(s[i - n : i], [0, 0])
                c[y] += 1
    return out


@pytest.mark.parametrize("order", [2, 3, 6])
def test_toxicity_letters_against_the_definition(order):
    r = random.Random(11)
    make = lambda: "".join(r.choice("abé\x7f") for _ in range(r.randrange(1, 9))).encode()
    counts = counts_of([(make(), r.randrange(2)) for _ in range(60)], order)
    pack = lambda g: len(g) << 48 | int.from_bytes(g, "big")
    model = toxicity.fit_letters(np.array([pack(g) for g in counts]), *(np.array([c[k] for c in counts.values()]) for k in (0, 1)), order)
    want = brute_letters(counts, order)
    words = [make() for _ in range(80)] + [b"zzz", b"a" * 40, "ab".encode() * 30, b"a"]
    assert np.allclose(np.column_stack(model.ratios(words)), [want(w) for w in words], atol=1e-5)
    assert (model.values(words) == model.ratios(words)[0]).all()
    place, starts, grams = toxicity.packed([b"ab", b"c"], 3)
    assert {int(x) for x in grams[grams >= 0]} == {pack(g) for g in counts_of([(b"ab", 0), (b"c", 0)], 3)}


def test_toxicity_score_against_plain_python(spark):
    """The whole way from the texts to the scores, written out once more without arrays, on documents that all go into the counts."""
    r = random.Random(12)
    vocabulary = [r.choice("bcd") + r.choice("aei") + r.choice("lmn") for _ in range(20)]
    docs = {i: " ".join([r.choice(vocabulary) for _ in range(r.randrange(3, 12))] + (["zok"] if i % 3 == 0 else [])) for i in range(40)}
    labels = [(i, int(i % 3 == 0)) for i in docs]
    import zlib

    rows = table(spark, list(docs.items()))
    model = toxicity.train(rows, labels_of(spark, labels, "toxic"))
    known = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]  # under 40 of a class: all go into both the counts and the curve
    lines = {i: docs[i].encode().split() for i in docs}
    word = brute_letters(counts_of([(w, y) for i, y in known for w in lines[i]], 6), 6)
    runs = lambda ws: [b" ".join(ws[k : k + n]) for n in (2, 3) for k in range(len(ws) - n + 1)]
    several: dict = {}
    for i, y in known:
        for g in runs(lines[i]):
            several.setdefault(g, [0, 0])[y] += 1
    sizes = [sum(len(lines[i]) for i, y in known if y == k) for k in (0, 1)]
    gains = {}
    for g, c in several.items():
        p = [max(c[k] - 0.75, 0) / sizes[k] + 1 / sum(sizes) for k in (0, 1)]
        if sum(c) >= 3 and p[1] > p[0]:
            gains[g] = math.log(p[1] / p[0])
    found = model.measure([docs[i].encode() for i in docs])
    for i, row in zip(docs, found):
        values = [word(w)[0] for w in lines[i]]
        want = [max(values), max((gains.get(g, 0.0) for g in runs(lines[i])), default=0.0), len(values), sum(values) / len(values)]
        whole, high = (sorted((word(w)[k] for w in set(lines[i])), reverse=True) for k in (1, 2))
        shares = [sum(word(w)[2] > m for w in lines[i]) / len(lines[i]) for m in toxicity.MARKS]
        want += [whole[0], sum(whole[:3]), high[0], sum(high[:3]), sum(high[:6]), sum(word(w)[1] for w in lines[i]) / sum(len(w) + 1 for w in lines[i]), *shares]
        want += [math.log1p(sum(x > toxicity.MARKS[1] for x in high)), math.log(len(lines[i])), math.log(1e-3 + shares[1])]
        assert np.allclose(row, want, atol=1e-3), i
    got = by_id(toxicity.classify(rows, labels_of(spark, labels, "toxic")))
    for i, row in zip(docs, found):
        peak = max(model.laws[k][1] * row[k] - model.laws[k][0] - math.log(row[2]) for k in (0, 1))
        z = [(min(max(v, a), b) - c) / d for v, a, b, c, d in zip(toxicity.told(row[None])[0], model.curve.low, model.curve.high, model.curve.centre, model.curve.scale)]
        terms = [1.0, *z, *(z[a] * z[b] for a in range(len(z)) for b in range(a, len(z)))]
        odds = max(model.slope * peak + model.shift, sum(a * b for a, b in zip(terms, model.curve.beta)))
        assert abs(got[i].score - 1 / (1 + math.exp(-max(-30, min(30, odds))))) < 1e-6


def test_toxicity_cuts_long_texts_at_blanks(monkeypatch):
    r = random.Random(13)
    letters = toxicity.fit_letters(*(lambda c: (np.array([len(g) << 48 | int.from_bytes(g, "big") for g in c]), *(np.array([v[k] for v in c.values()]) for k in (0, 1))))(counts_of([(b"abc", 0), (b"abd", 1), (b"b", 1)], 6)))
    model = toxicity.Model(letters, {b"abd b": 2.0, b"b abc abd": 3.0}, 3)
    texts = [b" ".join(r.choice([b"abc", b"abd", b"b", b"x" * 50]) for _ in range(n)) for n in (0, 1, 40, 400)] + [b"y" * 500, b" \n "]
    whole = model.measure(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 16)
    assert np.allclose(model.measure(texts), whole) and [b" ".join(toxicity.byte_words(t.lower())) for t in texts] == [b" ".join(w for c in toxicity.chunks(t) for w in c) for t in texts]


def test_toxicity_by_length(spark):
    r = random.Random(18)
    vocabulary = [a + b + c + d for a in "bcdfg" for b in "aeiou" for c in "lmnrst" for d in ("a", "en", "is")]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, labels = [], []
    for i in range(600):
        w = line(r.randrange(5, 300))
        if i % 4 == 0:
            at = r.randrange(len(w))
            w[at : at + 1] = ["zork" + r.choice(["a", "en", "is", "uf"])] if i % 8 else ["bala", "cemen", "diris"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    clean = {1000 + k: " ".join(w for w in line(20_000) if w != "cemen") for k in range(10)}  # else pairs of the expression come up
    clean |= {2000 + k: "".join(line(n)) for k, n in enumerate([40, 400, 4000, 20_000])}
    clean |= {3000 + k: " ".join("".join(line(40)) for _ in range(50)) for k in range(10)}
    toxic = {4000 + k: " ".join([*line(10_000), "zorken", *line(10_000)]) for k in range(5)}
    toxic |= {5000 + k: " ".join([*line(50), "bala", "cemen", "diris", *line(50)]) for k in range(5)}
    apart = {6000 + k: " ".join([*line(50), "diris", *line(5), "cemen", *line(5), "bala"]) for k in range(5)}
    docs = table(spark, [*rows, *clean.items(), *toxic.items(), *apart.items()])
    got = {i: x.predicted for i, x in by_id(toxicity.classify(docs, labels_of(spark, labels, "toxic"))).items()}
    assert [i for i in (*clean, *apart) if got[i]] == [] and [i for i in toxic if not got[i]] == []


def test_toxicity_in_every_language(spark):
    """Marks that are frequent, mild and a language's own: no language's toxic documents are missed, few ordinary ones are flagged."""
    import zlib

    r = random.Random(21)
    tongues = {"en": ("bdg", "ea", "lnr"), "de": ("ksz", "öu", "cht"), "fr": ("pmv", "éi", "xst"), "es": ("jñr", "oa", "dos")}
    rows, labels, of = [], [], {}
    for lang, (a, b, c) in tongues.items():
        syllables = [x + y + z for x in a for y in b for z in c]
        for i in range(400):
            n = r.randrange(20, 150)
            w = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n)]
            toxic = i % 6 == 0
            for k in range(n):
                # the stem of two rare syllables comes up in ordinary text too, but seldom
                if r.random() < (0.12 if toxic else 0.002):
                    w[k] = syllables[0] + syllables[-1] + r.choice(syllables)
            key = len(rows)
            of[key] = (lang, toxic)
            rows.append((key, " ".join(w)))
            labels.append((key, int(toxic)))
    got = by_id(toxicity.classify(table(spark, rows), labels_of(spark, labels, "toxic")))
    held = [i for i in of if zlib.crc32(str(i).encode()) % 5 == 0]
    for lang in tongues:
        mine = [i for i in held if of[i] == (lang, True)]
        assert len(mine) > 3 and sum(got[i].predicted for i in mine) >= 0.7 * len(mine), lang
    ordinary = [i for i in held if not of[i][1]]
    assert sum(got[i].predicted for i in ordinary) <= 0.06 * len(ordinary)


def test_one_row_of_a_labelled_id_is_learnt_from(spark):
    from tessella.llm.labelled import labelled, sample
    from pyspark.sql import functions as F

    docs = table(spark, [(7, f"copy {i}") for i in range(500)] + [(7, None), (8, None), (9, "other"), (None, "no id")])
    rows = labelled(docs, sample(labels_of(spark, [(7, 1), (7, 0), (8, 0), (9, 0), (None, 1)] * 3, "toxic"), "toxic", F.lit(True), 10)).collect()
    assert sorted((x.doc_id, x.text, x.y) for x in rows) == [(7, "copy 0", 1), (8, None, 0), (9, "other", 0)]


def test_quality_separates_noise(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        w = [r.choice("bcdfg") + r.choice("aeiou") * r.randrange(1, 4) + r.choice("lmnrst") for _ in range(r.randrange(20, 200))]
        if i % 3 == 0:
            w = [x + "%%%" for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        rows.append((i, ". ".join(w)))
        labels.append((i, int(i % 3 != 0)))
    rows += [(1000, None), (1001, ""), (1002, "y " * 50_000)]
    got = by_id(quality.classify(table(spark, rows), labels_of(spark, labels, "quality")))
    import zlib

    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and g.predicted == (g.score >= 0.7) for i, g in got.items())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    constant = by_id(quality.classify(table(spark, rows[:5]), labels_of(spark, [], "quality")))
    assert {g.score for g in constant.values()} == {0.5}


def test_quality_scores_against_plain_densities():
    r = np.random.default_rng(14)
    x = np.concatenate([r.normal(size=(80, 14)), r.normal(size=(60, 14)) * 1.5 + 0.7])
    y = np.repeat([0, 1], [80, 60])
    model = quality.Model(x, y)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)
    means, scatter = [z[y == c].mean(axis=0) for c in (0, 1)], []
    for c in (0, 1):
        scatter.append(sum(np.outer(v - means[c], v - means[c]) for v in z[y == c]))
    pooled = (scatter[0] + scatter[1]) / (len(y) - 2)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled) + 1e-3)
    density = []
    for c in (0, 1):
        s = 0.85 * scatter[c] / ((y == c).sum() - 1) + 0.15 * pooled + 1e-3 * np.eye(14)
        inverse, size = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density.append(np.array([-0.5 * (v - means[c]) @ inverse @ (v - means[c]) - 0.5 * size for v in z]))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30))))


def test_rules_against_an_independent_em(spark, texts):
    """Expectation-maximisation once more, over single texts with numpy, to the same verdicts."""
    docs = table(spark, texts)
    names = list(rules.votes())
    rows = rules.statistics(docs).withColumns({f"v_{k}": v for k, v in rules.votes().items()}).collect()
    cast = np.array([[x[f"v_{k}"] for k in names] for x in rows])
    odds = np.where(cast > 0, 0.69, np.where(cast < 0, -2.94, 0.0)).sum(axis=1)
    for _ in range(rules.ROUNDS):
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        odds = np.full(len(rows), np.log((good.sum() + 1) / (len(rows) - good.sum() + 1)))
        for j in range(len(names)):
            for v in (1, -1, 0):
                hit = cast[:, j] == v
                rate = [(w[hit].sum() + 1) / (w.sum() + 3) for w in (good, 1 - good)]
                odds[hit] += np.log(rate[0] / rate[1])
    want = sorted((x.doc_id or -1, round(float(p), 6)) for x, p in zip(rows, 1 / (1 + np.exp(-odds))))
    judged = rules.judge(docs).collect()
    assert sorted((x.doc_id or -1, round(x.p_good, 6)) for x in judged) == want
    assert all(x.kept == (not x.base_failed and x.p_good >= 0.5) for x in judged)


CLASHES = ["gone_id", "of_doc", "of_doc_spans", "document", "spans", "key", "key_", "first", "size", "bands", "hashes", "root", "node", "component_id", "cluster", "n", "shard", "given", "y", "aside", "gram", "score", "t", "w", "fp", "a", "b"]


def test_clashing_names_pass_through(spark):
    """Columns named like everything the operators and stages use inside stay what they are."""
    from tessella.llm import near

    same = " ".join(f"w{i}" for i in range(60))
    rows = [(i, same if i % 2 else f"{same} x{i} a@b.cd", "en", f"s{i % 2}", 1, *range(len(CLASHES))) for i in range(6)] + [(None, None, None, None, None, *range(len(CLASHES)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} int" for c in CLASHES))
    labels = spark.createDataFrame([(0, 1, 5), (1, 0, 5)], "doc_id long, toxic int, text int")
    for out in (toxicity.keep_ordinary(docs, labels), near.keep_one(docs), simhash.keep_one(docs), substring.without_repeats(docs), pii.masked(docs)):
        assert out.schema.names == docs.schema.names
        assert all(tuple(x)[5:] == tuple(range(len(CLASHES))) for x in out.collect())
    assert {x.doc_id for x in near.keep_one(docs).collect()} == {0, None}
    for out in (substring.deduplicate(docs), simhash.simhash_components(docs), rules.judge(docs), pii.find(docs), pieces.encode(docs), toxicity.classify(docs, labels), quality.classify(docs, labels.withColumnRenamed("toxic", "quality"))):
        assert out.count() == 7
    assert sum(len(x.doc_ids) for x in packing.pack(docs).collect()) == 7


def test_repeated_rows(spark):
    same = " ".join(f"w{i}" for i in range(60))
    docs = table(spark, [(1, same)] * 300 + [(2, same)] * 300)
    labels = labels_of(spark, [(1, 1), (2, 0)], "toxic")
    assert {(x.doc_id, x.n_removed) for x in substring.deduplicate(docs).collect()} == {(1, 0), (2, 60)}
    spans = substring.covered(docs.select("doc_id", "text")).collect()
    assert [(x.doc_id, len(x.spans) <= 45) for x in spans] == [(2, True)]
    for out in (toxicity.classify(docs, labels), quality.classify(docs, labels.withColumnRenamed("toxic", "quality")), pieces.encode(docs)):
        got = [tuple(map(str, x)) for x in out.collect()]
        assert len(got) == 600 and len(set(got)) == 2


def test_empty_tables(spark):
    empty = table(spark, [])
    assert substring.deduplicate(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert rules.judge(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert pieces.encode(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert toxicity.classify(empty, labels_of(spark, [], "toxic")).count() == 0
    assert quality.classify(empty, labels_of(spark, [], "quality")).count() == 0


def test_rows_without_ids_are_kept(spark):
    rows = [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (None, None), (4, "alpha beta gamma"), (5, "alpha beta gamma"), (5, "alpha beta gamma")]
    docs = table(spark, rows)
    found = simhash.simhash_components(docs).collect()
    assert len(found) == 6 and {r.component_id for r in found if r.fingerprint != "0" * 16} == {4}
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(docs).collect()) == [0, 0, 0, 4]
    labels = labels_of(spark, [(4, 1), (5, 0)], "toxic")
    for out in (rules.judge(docs), pii.find(docs), pieces.encode(docs), toxicity.classify(docs, labels), quality.classify(docs, labels.withColumnRenamed("toxic", "quality"))):
        assert sum(r.doc_id is None for r in out.collect()) == 3
    packed = [d for r in packing.pack(docs).collect() for d in r.doc_ids]
    assert sorted((d or 0) for d in packed) == [0, 0, 0, 4, 5, 5]
    assert simhash.keep_one(docs).columns == substring.without_repeats(docs).columns == docs.columns


def test_one_very_long_text(spark):
    r = random.Random(1)
    words = [r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrst") for _ in range(120_000)]
    docs = table(spark, [(1, " ".join(words)), (2, " ".join(words[50_000:90_000])), (3, "z" * 300_000)])
    got = by_id(substring.deduplicate(docs))
    assert (got[2].n_words, got[2].n_removed) == (40_000, 40_000) and got[3].n_words == 1
    assert by_id(rules.judge(docs))[1].n_words == 120_000 and by_id(pieces.encode(docs, with_ids=False))[3].round_trip
    assert sum(r.n_words for r in packing.pack(docs).collect()) == 160_001
