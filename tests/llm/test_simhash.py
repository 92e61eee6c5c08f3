import re

import pyarrow.parquet as pq
import xxhash

from netloom.llm import simhash

DOCS = "/root/testdata/sf0.001/documents.parquet"
SCHEMA = "doc_id long, text string, source string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, prints):
    name = dict.fromkeys(range(len(ids)))
    name = {i: i for i in name}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                name[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        least[r] = min([v for v in (least.get(r), x) if v is not None], default=None)
    return [least[root(i)] for i in range(len(ids))]


def check(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_components([r[0] for r in rows], prints), strict=True)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_whole_table_against_brute_force(spark):
    rows = pq.read_table(DOCS, columns=["doc_id", "text", "source"]).to_pylist()
    check(spark, [(r["doc_id"], r["text"], r["source"]) for r in rows])


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "One two", "b"), (4, "One two", "b"), (None, "one TWO", "c"),
            (None, "alone here now", "c"), (7, text, "d"), (8, text + " end", "d"), (9, text * 50, "d"), (10, "É x y z", "d")]
    check(spark, rows)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_of_planted_bits(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = list(dict.fromkeys(base + [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (1, 2, 3, 3, 4, 5)]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(r) for r in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "__fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if (prints[i] ^ (b % (1 << 64))).bit_count() <= 3}
    assert got == want


def test_keep_one_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (5, "something else here", "a"), (None, "no id at all", "n"), (None, "no id at all", "n")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
    assert got == sorted([(2, text, "b"), (5, "something else here", "a"), (None, "no id at all", "n")], key=str)


def similarity(a, b):
    def shingles(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)} or {" ".join(ws)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def plain_copies(rows):
    """Of each row, the least row index of its group of near copies."""
    group = list(range(len(rows)))
    close = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(rows[i][1], rows[j][1]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in close:
            low = min(group[i], group[j])
            if (group[i], group[j]) != (low, low):
                group[i] = group[j] = low
                changed = True
    return group


def test_near_copies_against_brute_force(spark):
    import random

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([6, 80, 200, 400]))]
        for _ in range(rng.randrange(1, 5)):
            ws = list(base)
            for _ in range(int(len(ws) * rng.choice([0, 0.002, 0.005, 0.01, 0.05, 0.3]))):
                ws[rng.randrange(len(ws))] = word()
            rows.append((len(rows), " ".join(ws), "s"))
    rows += [(900, None, "s"), (901, "", "s"), (902, "tiny text", "s"), (903, "Tiny  TEXT", "s")]
    got = {r.doc_id: r["__group"] for r in simhash.with_copies(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    want = plain_copies(rows)
    found = {}
    for i, r in enumerate(rows):
        found.setdefault(got[r[0]], set()).add(i)
    expected = {}
    for i, g in enumerate(want):
        expected.setdefault(g, set()).add(i)
    # No false group, and few pairs of the brute force missed: cells find a pair with high probability.
    assert all(len({want[i] for i in members}) == 1 for members in found.values())
    pairs = lambda groups: sum(len(m) * (len(m) - 1) // 2 for m in groups.values())
    assert pairs(found) >= 0.97 * pairs(expected) > 30
    assert not simhash.with_copies(spark.createDataFrame([], SCHEMA), ["doc_id"]).count()


def varied(rng, base, edits):
    ws = list(base)
    for at in rng.sample(range(len(ws)), edits):
        ws[at] = f"e{rng.getrandbits(60)}"
    return " ".join(ws)


def groups_of(spark, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {}
    for r in simhash.with_copies(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect():
        got.setdefault(r["__group"], set()).add(r.doc_id)
    return sorted(map(sorted, got.values()))


def test_thousands_of_variants_of_one_base(spark):
    import random

    rng = random.Random(21)
    base = [f"b{i}" for i in range(300)]
    # Five edited words leave some 0.85 to the base and some 0.7 between two variants.
    texts = [varied(rng, base, 5) for _ in range(2999)] + [" ".join(base)]
    near = [i for i, t in enumerate(texts) if similarity(t, " ".join(base)) >= 0.8]
    assert len(near) > 2900 and set(near) <= set(max(groups_of(spark, texts), key=len))


def test_pairs_inside_a_crowded_family(spark):
    import random

    rng = random.Random(22)
    # A family shares 200 of 300 words (under 0.8); some members have a near copy.
    frame = [f"f{i}" for i in range(200)]
    texts = [" ".join(frame + [f"m{rng.getrandbits(60)}" for _ in range(100)]) for _ in range(300)]
    texts += [varied(rng, texts[i].split(), 4) for i in range(60)]
    want = [[i, 300 + i] if similarity(texts[i], texts[300 + i]) >= 0.8 else [i] for i in range(60)]
    assert sorted(want + [[i] for i in range(60, 300)] + [[300 + w[0]] for w in want if len(w) == 1]) == groups_of(spark, texts)


def test_blocks_find_what_hubs_do_not(spark, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "CROWD", 2)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(23)
    texts = []
    for family in range(3):
        base = [f"{family}x{i}" for i in range(120)]
        texts += [varied(rng, base, rng.choice([1, 2, 3, 4])) for _ in range(60)]
    group = plain_copies([(i, t) for i, t in enumerate(texts)])
    want = {}
    for i, g in enumerate(group):
        want.setdefault(g, []).append(i)
    assert groups_of(spark, texts) == sorted(want.values())
