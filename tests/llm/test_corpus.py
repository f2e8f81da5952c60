"""Operators 2, 4, 6, 7, 8, 9 and 10 and the pipeline against brute force on small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lifecurve.llm import curriculum, exactdedup, langid, licenses, simhash, spotsigs, surrogates
from lifecurve.llm.components import components
from lifecurve.llm.queries import ORACLES, QUERIES


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Operator 4.


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    n = min(3, len(words))
    hashed = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def labels(values, linked):
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in combinations(values, 2):
        if linked(a, b):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {v: top(v) for v in values}


def test_simhash_rows(docs, none, rows):
    fps = {plain_fingerprint(r[1]) for r in rows}
    root = labels(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            k = root[plain_fingerprint(text)]
            least[k] = min(doc, least.get(k, doc))
    want = [(r[0], f"{(f := plain_fingerprint(r[1])):016x}", least.get(root[f])) for r in rows]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")), "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(docs).count() == len({root[plain_fingerprint(r[1])] for r in rows})


@pytest.mark.parametrize("limit", [2, 1000])
def test_links_reach_the_same_components(spark, limit):
    """Chains of few flips, crowds in one bucket and strangers, with small and large buckets."""
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(40)}
    for v in list(values)[:8]:
        for _ in range(25):
            v ^= 1 << rnd.randrange(64)
            values.add(v)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {r["a"]: r["b"] for r in components(simhash.links(frame, 2, limit)).collect()}
    want = labels(sorted(signed.values()), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {v: got.get(v, v) for v in signed.values()} == want


def test_thresholds_sum_and_cost():
    cost, chosen = simhash.allocate([[5.0, 50.0, 500.0], [1.0, 2.0, 900.0], [7.0, 70.0, 700.0]], 0)
    assert sum(chosen) == 0 and chosen == [0, 1, -1] and cost == 7.0


# Operator 10.


def test_exact_dedup_rows(docs, none, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    got = exactdedup.dedup(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in got) == Counter(
        (r[0], max((i for i in groups[lower(r[1])] if i is not None), default=None), len(groups[lower(r[1])]), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows
    )
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exactdedup.dedup(none).count() == 0
    assert exactdedup.one_of_each(docs).count() == len(groups)


def test_exact_dedup_with_history(docs):
    old, new = docs.where("doc_id < 105"), docs.where("doc_id >= 102 or doc_id is null")
    got = exactdedup.dedup(new, old).collect()
    assert {r["doc_id"] for r in got if r["member"]} == {102, 103}
    assert all(not r["kept"] and r["keep_id"] == 103 for r in got if r["member"])
    assert sum(r["kept"] for r in got) == new.where("doc_id not in (102, 103) or doc_id is null").select(F.lower(F.coalesce("text", F.lit("")))).distinct().count()


def test_perfect_hash_is_minimal():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), np.uint8).reshape(-1, 32)
    index = exactdedup.PerfectHash.build(digests)
    assert sorted(index.slots(digests).tolist()) == list(range(5000))
    assert index.slots(digests[:0]).size == 0 and exactdedup.PerfectHash.build(digests[:0]).slots(digests[:3]).tolist() == [-1] * 3


# Operator 6.


def test_language(docs, none, rows):
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in rows[:60] if r[0] != 7 and by_id[r[0]]["held_out"]]
    assert held and all(by_id[r[0]]["lang_pred"] == r[2] and not by_id[r[0]]["rejected"] for r in held)
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["rejected"] for k in (200, 201, 202, 203))
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_language_rejects_other_scripts(spark, docs):
    other = spark.createDataFrame([(1, "Σήμερα ο καιρός είναι καλός και πάμε στη θάλασσα με τα παιδιά " * 3)], "doc_id long, text string")
    assert langid.identify(other, langid.fit(docs)).first()["rejected"]


# Operator 7.


def test_spotsigs_rows(docs, none, rows, monkeypatch):
    monkeypatch.setattr(spotsigs, "LEAST_ROWS", 16)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = (set(spotsigs.spots(t).tolist()) for t in (text, changed, after))
        want.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9)))
    got = spotsigs.fingerprint_edits(docs).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert len(np.frombuffer(base64.b64decode(r["fingerprint"]), "<u4")) == r["n_spots"]
    assert spotsigs.fingerprint_edits(none).count() == 0
    assert spotsigs.fingerprint_edits(docs.where("doc_id = 3")).first()["near_next"] == 1.0


def test_spots_and_pruned_likeness():
    assert len(spotsigs.spots("The old river of the winter garden runs")) == 3
    assert (spotsigs.spots("no anchor") == spotsigs.spots("No, anchor!")).all()
    rnd = random.Random(1)
    for _ in range(200):
        a, b = (np.array(sorted(rnd.sample(range(900), rnd.randint(1, 600))), np.uint32) for _ in range(2))
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert spotsigs.likeness(a, b) == true
        assert spotsigs.likeness(a, b, 0.3) == (true if true >= 0.3 else 0.0) or true < 0.3
        if true >= 0.8:
            assert abs(spotsigs.length_class(a.size) - spotsigs.length_class(b.size)) <= 1


# Operator 8.


def test_mix(docs, none, rows):
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size[id(r)] for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    got = curriculum.plan_mix(docs, chunk_rows=10).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((r[0], size[id(r)], total[r[3]], round(target[r[3]], 6)) for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["passes"] * r["size"]
        taken[round(r["target"], 6)] += r["taken"]
        largest[round(r["target"], 6)] = max(largest[round(r["target"], 6)], r["size"])
        assert r["passes"] == len(r["times"] or []) and all(0 <= t <= 1 for t in r["times"] or [])
    assert all(abs(taken[t] - t) <= largest[t] for t in taken)
    again = curriculum.plan_mix(docs, chunk_rows=1000).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    assert curriculum.mixed(docs).count() == sum(r["passes"] for r in got) and curriculum.mixed(docs).columns == docs.columns
    assert curriculum.plan_mix(none).count() == 0


def test_schedule_inverts_its_integral(spark):
    times = [k / 20 for k in range(21)]
    for a, b in curriculum.RAMPS:
        frame = spark.createDataFrame([(t,) for t in times], "t double").select("t", curriculum.integral(F.col("t"), a, b).alias("p"))
        back = frame.select("t", curriculum.time_of(F.col("p"), F.lit(a), F.lit(b)).alias("again")).collect()
        assert all(abs(r["t"] - r["again"]) < 1e-9 for r in back)


# Operator 9.


def test_licenses(spark, docs, none, rows):
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    assert Counter(tuple(r["families"]) for r in got) == Counter(("mit",) if "MIT License" in (r[1] or "") else () for r in rows)
    model = licenses.fit(docs)
    lines = {"Licensed under CC BY-NC 4.0.": ["cc-by-nc"], "und\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.": ["apache", "mit"],
             "This work is licensed under the GNU General Public License, version 3.": ["gpl"], "A license to drive was lost in the river.": [], "the version of the public work": [], "": []}
    more = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc_id"]: r["families"] for r in licenses.scan(more, model).collect()} == dict(enumerate(lines.values()))
    assert licenses.scan(none).count() == 0


# Operator 2.


def test_permutations_are_one_to_one_without_fixed_points():
    p = surrogates.Permuter("k")
    for a, b in ((1, 2), (7, 1), (10, 10), (26, 37)):
        out = [p.number("x", v, a, b) for v in range(a * b)]
        assert sorted(out) == list(range(a * b)) and all(v != o for v, o in enumerate(out))
    s = surrogates.Surrogates("k")
    for kind, values in {
        "email": [f"{c}{n}@mail{n % 3}.example.com" for c in "abcxyz" for n in range(50)],
        "ipv4": [f"10.{a}.{b}.7" for a in range(20) for b in range(20)],
        "account": [f"41111111{n:08d}" for n in range(0, 99_999_999, 250_001)],
        "person": [f"|{n.lower()}" for names in surrogates.GIVEN.values() for n in names] + ["|zork", "|zark", "|smith", "|петрова"],
    }.items():
        made = [s.canonical(kind, v) for v in values]
        assert len(set(made)) == len(values) and not any(a == b for a, b in zip(made, values, strict=True))
    assert all(surrogates.luhn(v[:-1]) == int(v[-1]) for v in [s.canonical("account", "4111111111111111")])


def test_surrogates_keep_form_gender_script_and_reference(docs, none, rows):
    text = "Mrs Anna Fox met Herr Peter Klein. Mrs Anna FOX wrote to Ann.Lee@Site.org and ANN.LEE@SITE.ORG, +1 (017) 555-7713 or (017) 555-7713, Госпожа Вера Петрова; 4111 1111 1111 1111, 078-05-1120, token = \"0123456789abcdef0123456789abcdef01234567\", 10.20.30.40."
    out, found = surrogates.Surrogates("k").replace(text)
    kinds = Counter(k for _, _, k, _ in found)
    assert kinds == {"person": 8, "email": 2, "phone": 2, "account": 1, "ssn": 1, "secret": 1, "ipv4": 1}
    for gone in ("Anna", "Fox", "FOX", "Peter", "Klein", "Ann.Lee", "555-7713", "Вера", "Петрова", "4111 1111", "078-05", "0123456789abcdef", "10.20.30.40"):
        assert gone not in out
    m = re.match(r"Mrs (\w+) (\w+) met Herr (\w+) (\w+)\. Mrs (\w+) (\w+) wrote to (\S+) and (\S+), (\+1 \(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4}), Госпожа (\w+) (\w+); \d{4} \d{4} \d{4} \d{4}, \d{3}-\d{2}-\d{4}, token = \"[0-9a-f]{40}\", [\d.]+\.$", out)
    assert m and m[1] == m[5] and m[2].upper() == m[6] and m[7].lower() == m[8].lower() and m[8].isupper()
    assert m[1] in surrogates.GIVEN["f", "latin"] and m[3] in surrogates.GIVEN["m", "latin"] and m[11] in surrogates.GIVEN["f", "cyrillic"]
    assert surrogates.Surrogates("other").replace(text)[0] != out
    got = surrogates.surrogates(docs).collect()
    before = {r[0]: r[1] for r in rows if r[0] not in (None, 7)}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in before and not r["n_entities"]:
            assert r["text"] == before[r["doc_id"]]
    assert next(r for r in got if r["doc_id"] == 205)["kinds"] == ["email", "email", "phone", "ipv4", "account", "person", "person"]
    assert surrogates.surrogates(none).count() == 0


def test_shared_surrogates_are_found(spark):
    rows = [("email", "a", "x", 1), ("email", "b", "x", 1), ("ipv4", "c", "c", 2), ("ipv4", "d", "e", 1)]
    bad = surrogates.collisions(spark.createDataFrame(rows, "kind string, value string, surrogate string, n long"))
    assert {(r["kind"], r["surrogate"]) for r in bad.collect()} == {("email", "x"), ("ipv4", "c")}


# The pipeline and the registered queries.


def test_pipeline(spark, folder, rows):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    steps = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/stage{k}")
        now = steps[name] = spark.read.parquet(f"{folder}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
    ids = {name: Counter(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in steps.items()}
    assert not {200, 201, 202, 203} & set(ids["language"]) and set(range(60)) <= set(ids["language"])
    assert ids["language"][7] == 3 and ids["exact_copies"][7] == 2 and set(ids["exact_copies"]) & {100, 101, 102, 103} == {103}
    texts = {r["text"] for r in steps["near_copies"].collect()}
    assert len(texts) == len({plain_fingerprint(t) for t in texts})
    assert all(n <= 2 for doc, n in ids["mix"].items() if doc != 7) and ids["tokens"] == ids["mix"]
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, steps["tokens"].collect()))


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)
