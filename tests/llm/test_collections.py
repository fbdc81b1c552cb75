import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import mixing, near_duplicates as nd, packing, tokens

KINDS = {"content": ("words", 3), "name": ("characters", 3)}


def jaccard(a, b, kind):
    x, y = nd.shingle_set(a, *kind), nd.shingle_set(b, *kind)
    return len(x & y) / len(x | y) if x and y else 0.0


def brute(rows, threshold, skip=lambda p, v: False):
    rows = sorted({r for r in rows if r[2] and not skip(r[0], r[2])})
    return {(p, min(k, l), max(k, l)) for i, (p, k, v) in enumerate(rows) for q, l, w in rows[i + 1 :] if p == q and k != l and jaccard(v, w, KINDS[p]) >= threshold}


def corpus(seed=3, groups=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.randint(20, 80))]
        for c in range(r.randint(1, 4)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append(("content", f"d{g}-{c}", " ".join(t)))
        name = "".join(r.choice("абвгдежзи") for _ in range(30))
        rows += [("name", f"n{g}", name), ("name", f"n{g}b", name[:-1] + "я"), ("name", f"n{g}c", name.upper())]
    return rows


def pairs(spark, rows, threshold=0.6, **o):
    df = spark.createDataFrame(rows, "place string, key string, value string")
    links, members = nd.near_duplicates(df, KINDS, threshold, **o)
    return {tuple(r) for r in nd.record_pairs(links, members).collect()}, links, members


@pytest.mark.parametrize("cap,block", [(1024, 8192), (3, 2)])
def test_pairs_equal_brute_force(spark, cap, block):
    """Also when runs above the cap go through blocks."""
    rows = corpus() + [("content", "null", None), ("content", "empty", ""), ("name", "ab", "ab"), ("content", "two", "two words")]
    rows += rows[:5]
    got, _, _ = pairs(spark, rows, run_cap=cap, block=block)
    assert got == brute(rows, 0.6)


def test_skip_copies_and_classes(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [("content", f"copy{i:02d}", text) for i in range(40)] + [("content", "near", text + " more"), ("content", "far", " ".join(f"u{i}" for i in range(60))), ("content", "bad", "BAD " + text)]
    got, links, members = pairs(spark, rows, skip=lambda p, v: v.startswith("BAD"))
    assert len(got) == 41 * 40 // 2 and links.count() == 1 and not any("bad" in p for p in got)
    by = {r["key"]: r for r in nd.classes(links, members).collect()}
    assert len({by[k]["class_id"] for k in by if k != "far"}) == 1 and by["far"]["class_id"] != by["near"]["class_id"] and by["near"]["links"] == 1 and by["far"]["links"] == 0


def test_chain_is_one_class(spark):
    words = [f"c{i}" for i in range(200)]
    rows = [("content", f"k{i:02d}", " ".join(words[i * 4 : i * 4 + 60])) for i in range(30)]
    _, links, members = pairs(spark, rows)
    assert nd.classes(links, members).select("class_id").distinct().count() == 1


def test_long_chains_are_one_class_each(spark):
    """Also chains far longer than the rounds: random and rising ids, a ring, one link to each side and three."""
    r = random.Random(7)
    links, want = [], {}
    for name, n, near, ids in (("random", 500, 1, r.sample(range(10**9), 500)), ("rising", 400, 1, range(400)), ("wide", 500, 3, r.sample(range(10**9), 500)), ("ring", 301, 1, [*r.sample(range(10**9), 300), None])):
        ids = [ids[0] if i is None else i for i in ids]
        links += [(name, min(a, b), max(a, b)) for i, a in enumerate(ids) for b in ids[i + 1 : i + 1 + near]]
        want |= {(name, f"k{i}"): min(ids) for i in ids}
    links += [("pair", 5, 4), ("pair", 4, 5), ("random", 10**9 + 2, 10**9 + 1)]  # the same set numbers in two places, a link given twice
    want |= {("pair", "k4"): 4, ("pair", "k5"): 4, ("random", f"k{10**9 + 1}"): 10**9 + 1, ("random", f"k{10**9 + 2}"): 10**9 + 1, ("alone", "k9"): 9}
    members = spark.createDataFrame([(p, k, int(k[1:])) for p, k in want], "place string, key string, fp long")
    df = spark.createDataFrame(links, "place string, a long, b long")
    got = nd.classes(df, members).collect()
    assert {(x["place"], x["key"]): x["class_id"] for x in got} == want and len(got) == len(want)
    assert {x["links"] for x in got if x["place"] == "pair"} == {1} and {x["links"] for x in got if x["place"] == "ring"} == {2} and [x["links"] for x in got if x["place"] == "alone"] == [0]
    with pytest.raises(RuntimeError):
        nd.classes(df, members, rounds=2)


def test_empty_and_estimates(spark):
    got, _, _ = pairs(spark, [("content", "a", None)])
    assert got == set()
    assert nd._least_bits(0.6, 4) == 84 and nd._least_bits(1.0, 4) == 128


def test_long_texts(spark):
    base = " ".join(f"w{i % 5000}" for i in range(60_000))
    got, _, _ = pairs(spark, [("content", "a", base), ("content", "b", base + " tail"), ("content", "c", "x y z")])
    assert got == {("content", "a", "b")}


# ---- packing


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 60))
@settings(max_examples=100, deadline=None)
def test_plan_places_every_rank_once(sizes, capacity):
    counts = {s: sizes.count(s) for s in sizes}
    room, placed = {}, {}
    for size, lo, hi, first, per in packing.plan(counts, capacity):
        for r in range(lo, hi):
            c = first + (r - lo) // per
            room[c] = room.get(c, 0) + size
            placed[size, r] = placed.get((size, r), 0) + 1
    assert placed == {(s, r): 1 for s in counts for r in range(counts[s])} and all(v <= capacity for v in room.values())
    # best fit leaves at most one container half empty
    assert sum(v * 2 <= capacity for v in room.values()) <= 1


def naive_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_pack(spark):
    r = random.Random(5)
    sizes = [(i, r.choice([7, 7, 7, r.randint(1, 300)])) for i in range(400)] + [(1000, 0), (1001, None), (1002, 200), (1003, 100)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("piece", F.lit("clash"))
    got = packing.pack(df, [("a", 100), ("b", 512)]).collect()
    for name, cap in (("a", 100), ("b", 512)):
        rows = [x for x in got if x["pack_name"] == name]
        per = {}
        for x in rows:
            per[x["container_id"]] = per.get(x["container_id"], 0) + x["tokens"]
        assert max(per.values()) <= cap and sum(per.values()) == sum(n or 0 for _, n in sizes)
        pieces = [p for _, n in sizes if n for p in ([cap] * (n // cap) + ([n % cap] if n % cap else []) if n > cap else [n])]
        assert len(per) == naive_best_fit(pieces, cap)
        whole = {x["doc_id"] for x in rows if x["piece"] > 0}
        assert whole == {d for d, n in sizes if n and n > cap}
    rep = packing.report(packing.pack(df, [("a", 100)]), [("a", 100)]).first()
    assert 0.9 < rep["fill"] <= 1 and rep["fullest"] <= 100
    assert packing.pack(df.limit(0), [("a", 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [("a", 0)])


# ---- mixing

TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.0, 1), ("absent", 0.1, 3)]


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, s, r.randint(1, 40)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["small"] * 100 + ["other"] * 50 + ["none"] * 5)]
    docs += [(9000, None, 5), (9001, "big", 0), (9002, "big", None)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(TARGETS + TARGETS[:1], "source string, target_share double, max_repeats int")
    got = mixing.mix(sizes, targets, slices=16)
    rep = {x["source"]: x for x in mixing.report(got, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(rep[s]["actual_share"] - share) < 0.02 and rep[s]["most_repeats"] <= rep[s]["max_repeats"]
    assert rep["small"]["most_repeats"] == 4 and rep["absent"]["tokens"] == 0
    # exactly what one sorted pass would take, in order of finish times
    budget = 5000
    some = mixing.mix(sizes, targets, budget=budget, slices=16).collect()
    every = sorted((x["finish"], x["source"], x["epoch"], x["doc_id"], x["tokens"]) for x in mixing.mix(sizes, targets, budget=10**9, slices=16).collect())
    take, spent = [], 0
    for row in every:
        if spent + row[4] > budget:
            break
        spent += row[4]
        take.append((row[3], row[2]))
    assert sorted((x["doc_id"], x["epoch"]) for x in some) == sorted(take)
    assert mixing.mix(sizes.limit(0), targets).count() == 0 and mixing.report(mixing.mix(sizes.limit(0), targets), targets).count() == 5


def test_mix_of_the_whole_corpus_is_not_cut_by_a_scarce_source(spark, tmp_path, monkeypatch):
    """One source with one short document: the others still send as much as the corpus holds."""
    from textloom.llm import queries

    rows = [(i, s, "x " * 9) for i, s in enumerate(["big"] * 300 + ["mid"] * 200 + ["tiny"] + ["other"] * 20)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 2), ("mid", 0.4, 2), ("tiny", 0.1, 4), ("none", 0.2, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    monkeypatch.setattr(tokens, "sized", lambda df, text: df.withColumn("tokens", F.lit(10).cast("long")).drop(text))
    got = queries.p7_mix(spark, str(tmp_path))
    assert got.agg(F.sum("tokens")).first()[0] == 5010  # 501 documents of sources with a target
    rep = {x["source"]: x for x in queries.p7_report(spark, str(tmp_path)).collect()}
    assert rep["tiny"]["most_repeats"] == 4 and rep["tiny"]["tokens"] == 40 and rep["tiny"]["used_share"] == 1.0
    assert abs(rep["big"]["tokens"] / rep["mid"]["tokens"] - 5 / 4) < 0.02 and rep["big"]["actual_share"] > 0.5
    used = {s: got.where(F.col("source") == s).select("doc_id").distinct().count() for s in ("big", "mid", "tiny")}
    assert rep["big"]["used_share"] == round(used["big"] / 300, 6) and rep["mid"]["available"] == 2000
    assert rep["none"]["tokens"] == rep["none"]["available"] == 0 and rep["none"]["used_share"] == 0.0
    assert {x["corpus_used"] for x in rep.values()} == {round(sum(used.values()) / 521, 6)}
    assert mixing.available(spark.createDataFrame([], "doc_id long, source string, tokens long"), spark.createDataFrame([("big", 0.5, 2)], "source string, target_share double, max_repeats int")) == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (4, "слово " * 5000, "d")], "doc_id long, text string, tokens_ string")
    try:
        got = {r["doc_id"]: r["tokens"] for r in tokens.sized(df, "text").collect()}
    except Exception:
        pytest.skip("no vocabulary here")
    assert got[2] == got[3] == 0 and got[1] == 2 and got[4] > 5000 and tokens.count("Hello world") == 2
