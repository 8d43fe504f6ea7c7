"""Each operator against brute force on small tables, and its defined results for odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from engram.llm import decontaminate, fingerprint, jaccard, licenses, lm, mixing, quality, substring, toxicity, warc
from engram.llm.graph import components
from engram.llm.textvec import ALNUM, SPACED, Block, shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(words, k=5):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def prose(g, n, vocabulary=4000):
    return " ".join(f"w{g.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Unrelated texts, exact and near copies, shared passages, odd rows."""
    g = random.Random(1)
    texts = [prose(g, g.choice([8, 60, 150, 400])) for _ in range(60)]
    passage = prose(g, 70)
    for i in range(6):
        base = texts[i].split()
        base[len(base) // 2] = "edited"
        texts += [texts[i], " ".join(base), f"{prose(g, 40)} {passage} {prose(g, 30)}"]
    boiler = prose(g, 20)
    texts += [f"{boiler} {prose(g, 3)}" for _ in range(12)]
    texts += [None, "", "  \n ", "one", "Two words", "one", "the " * 300, "ÄÖ ß ñandú — 日本語 \U0001f600 end of text here now"]
    return [(i, t, None if i % 17 == 0 else "en", None if i % 13 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles_of_a_block(rows):
    texts = [r[1] for r in rows]
    for inside, words_of in ((SPACED, spaced), (ALNUM, alnum)):
        block = Block(pa.array(texts), inside)
        assert [block.word(i) for i in range(len(block.h))] == [w for t in texts for w in words_of(t)]
        assert [len(s) for s in shingle_sets(block, 5)] == [len(shingles(words_of(t))) for t in texts]
    sliced = Block(pa.array(["x", *texts])[1:], SPACED)
    assert (sliced.h == Block(pa.array(texts), SPACED).h).all()


def test_components(spark):
    g = random.Random(2)
    links = [(g.randrange(300), g.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up if any(i in x and x[0] != x[1] for x in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(sets):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("bounds", "block"), [(None, 1024), ((1, 2), 1024), ((1, 1), 4), ((2, 1000), 4)])
def test_jaccard_join(docs, rows, monkeypatch, bounds, block):
    if bounds:
        monkeypatch.setattr(jaccard, "classes", lambda sets: bounds)  # pairs and threes of tokens, too
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    sets = {r[0]: shingles(spaced(r[1])) for r in rows}
    want = brute_links(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_signatures_never_miss_a_link():
    g = np.random.default_rng(0)
    most = 0
    for n in (1, 2, 4, 5, 12, 26, 60, 103, 250, 330, 900):
        for often in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (0.1, 0.5, 0.4), (0.05, 0.05, 0.9)):
            x = g.integers(0, 1 << 60, n).astype(np.uint64)
            held = g.choice([5, 50, 5000], n, p=often).astype(np.uint32)
            for kind in range(6):
                lost = g.permutation(n)[: jaccard.missing(n) if kind < 3 else jaccard.missing(n) // 2]
                y, kept = np.delete(x, lost), np.delete(held, lost)
                if kind >= 3:  # as many others instead, of which no other set holds any: equal sizes
                    lost = lost[: n // 9]
                    y, kept = np.delete(x, lost), np.delete(held, lost)
                sides = []
                for token, count, size in ((x, held, n), (y, kept, len(y) + (len(lost) if kind >= 3 else 0))):
                    order = np.lexsort((token, count))
                    sides.append(jaccard.signatures(size, token[order], count[order], (10, 100)))
                    most = max(most, len(sides[-1]) / max(size, 8))
                both = len(y)
                if both and both != n and 100 * both >= 80 * (n + (len(lost) if kind >= 3 else 0)):
                    assert len(np.intersect1d(*sides)), (n, often, kind)
    assert most < 20  # signatures of a set grow with its size, not with powers of it


def test_jaccard_odd_rows(spark, empty):
    assert jaccard.jaccard_components(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()), key=str)
    assert got == [(3, 2, 3), (3, 2, 3), (4, 0, 4), (9, 2, 3), (None, 2, None)]


def test_fingerprints(docs, rows, spark, empty):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    for i, t in ((r[0], r[1] or "") for r in rows):
        nxt = rows[(i + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles((t.lower()).split()), shingles(edited.lower().split())
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i]["near_edited"] - true) < 0.2
        assert got[i]["distinct_shingles"] == len(a) if len(a) < fingerprint.K else abs(got[i]["distinct_shingles"] / len(a) - 1) < 0.4
    assert got[60]["fingerprint"] == got[0]["fingerprint"]  # a copy
    assert fingerprint.fingerprints(empty).collect() == []
    odd = spark.createDataFrame([(None, "x y"), (None, None), (5, "a b"), (5, "a b"), (10**12, "c d e f g h")], "doc_id long, text string")
    assert fingerprint.fingerprints(odd).count() == 5
    one = fingerprint.fingerprints(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).head()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


def test_fingerprints_are_native(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 5, 9], [2, 5, 7])], "a array<long>, b array<long>")
    r = df.select(fingerprint.merge(F.col("a"), F.col("b"), 4).alias("m"), fingerprint.resemblance(F.col("a"), F.col("b"), 4).alias("r")).head()
    assert r["m"] == [1, 2, 5, 7] and r["r"] == 0.25


def test_warc(spark):
    g = random.Random(3)
    same = "<p>same</p>"
    pages = [(i, f"http://{'Hot.example' if i % 3 else f'h{i % 7}.org'}:80/p{i % 50}?q={i}#f", same if i % 4 == 0 else f"<p>{prose(g, 20)}ü</p>") for i in range(900)]
    pages += [(2000, None, None), (2001, "no url", ""), (2002, "http://a/ b", ""), (4, pages[4][1], same), (None, "http://x/", same)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = warc.new_folder(spark, "warc")
    manifest = warc.write_archives(df, folder)
    from pyspark.sql import functions as F

    keys = df.select(warc.urlkey(F.col("url")).alias("key"), F.coalesce("page_id", F.lit(warc.NO_ID)).alias("capture"))
    got = warc.look_up(keys, manifest, folder, contents=True).collect()
    assert len(got) == len(pages)
    text = {p: (h or "") for p, _, h in pages}
    owner = {}
    for p, t in text.items():
        owner[t] = max(owner.get(t, -1), -1 if p is None else p)
    for r in got:
        t = text[r["page_id"]].encode()
        revisit = r["page_id"] != owner[t.decode()]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(t), base64.b32encode(hashlib.sha1(t).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", owner[t.decode()]) if revisit else ("response", None))
        assert bytes(r["payload"]) == t if not revisit else r["payload"] is None
    host = df.select(warc.urlkey(F.lit("https://u:p@WWW.Example.com:8080/a/b?c#d")).alias("k")).head()["k"]
    assert host == "com,example,www)/a/b?c"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.look_up(keys, warc.write_archives(none, folder), folder).collect() == []


def test_license_scan(spark, empty):
    g = random.Random(4)
    full = " ".join(licenses.TEMPLATES["mit-text"].split())
    worn = " ".join(w for i, w in enumerate(full.split()) if i % 12)  # a twelfth of the words is gone
    texts = ["Under the MIT license. Under THE mit-license!", prose(g, 500) + " " + worn + " " + prose(g, 700), prose(g, 200), None, "", "apache license, version 2 cc by nc", "the software " * 500]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = alnum(t)
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        base = ",".join(sorted({x[1] for x in places}))
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["base_labels"]) == (len(w), len(places), base)
        assert (got[i]["first_word"], got[i]["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(base.split(",")) - {""} <= set(got[i]["labels"].split(","))
    assert got[1]["labels"] == "mit-text" and 0.8 <= got[1]["score"] < 1 and got[2]["labels"] == "" and got[6]["labels"] == ""
    assert licenses.scan(empty).collect() == []


def test_license_blocks_against_brute_force():
    """Every template and text: the best block of 2L words at each multiple of L."""
    g = random.Random(5)
    texts = []
    for t in licenses.TEMPLATES.values():
        w = t.split()
        texts.append(prose(g, g.randrange(60)) + " " + " ".join(x for x in w if g.random() < 0.85) + " " + prose(g, 30))
    known = licenses.Templates(licenses.TEMPLATES, 0.8, {})
    block = Block(pa.array(texts), ALNUM)
    got = {(d, label): round(share, 9) for d, label, share in known.find(known.ranks(block.h), block.first)}
    want = {}
    for d, t in enumerate(texts):
        w = alnum(t)
        for label, template in licenses.TEMPLATES.items():
            words = alnum(template)
            best = max(len(set(words) & set(w[s : s + 2 * len(words)])) for s in range(0, len(w), len(words)))
            if best >= 0.8 * len(set(words)) - 1e-9:
                want[d, label] = round(best / len(set(words)), 9)
    assert got == want and len(want) > 5


def test_language_model(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lm, "SHORT", 128)
    monkeypatch.setattr(lm, "HEAD", 500)  # most words are joined
    token = lambda t: [*spaced(t), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for r in rows if not held(r[0]) for w in token(r[1]))
    total, distinct = sum(count.values()), len(count)
    for r in lm.lm_scores(docs).collect():
        words = token(rows[r["doc_id"]][1])
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(count[w] > 0 for w in words), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] <= 0
    assert lm.lm_scores(empty).collect() == []


def test_network_is_a_distribution_and_learns():
    h = np.arange(300, dtype=np.uint64)
    v = lm.Vocabulary(h, np.arange(300, 0, -1), int(np.arange(301).sum()), 300)
    net = lm.Network(v)
    stream = np.tile(np.array([0, 5, 9, 130, 7], np.int32), 4000)
    before = net.score([stream[1:11]])[0]
    left = net.train(stream)
    assert 1 <= len(left) <= lm.LANES
    after = net.score([stream[1:11], stream[1:4], np.zeros(0, np.int32)])
    assert after[0] > before + 3
    state = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(v.rest + 1, dtype=np.int32)
    every = every[(every < v.short) | (every >= v.edge)]
    assert abs(np.exp(net.log_prob(np.repeat(state, len(every), 0), every)[0]).sum() - 1) < 1e-3


def test_slopes_of_the_network_against_differences(monkeypatch):
    """Every weight's slope, through the gates and over several steps."""
    monkeypatch.setattr(lm, "SHORT", 64)
    v = lm.Vocabulary(np.arange(90, dtype=np.uint64), np.arange(90, 0, -1), int(np.arange(91).sum()), 90)
    net, g = lm.Network(v), np.random.default_rng(1)
    some = np.array([c for c in range(v.rest + 1) if c < v.short or c >= v.edge], np.int16)
    xs, ys = g.choice(some, (5, 7)), g.choice(some, (5, 7))
    h = g.standard_normal((7, lm.HIDDEN)).astype(np.float32)

    def loss():
        states, now = [], h
        for t in range(5):
            gates = net.w["in"][xs[t]] @ net.w["x"] + net.w["b"]
            states.append(now := net.step(gates, now)[0])
        return -net.log_prob(np.concatenate(states), ys.ravel())[0].sum(dtype=float)

    slopes, codes, _ = net.slopes_of(xs, ys, h)
    for name, a in net.w.items():
        slope = slopes[name] if name != "in" else np.zeros_like(a)
        if name == "in":
            slope[codes] = slopes[name]
        for at in [np.unravel_index(i, a.shape) for i in np.argsort(-np.abs(slope).ravel())[:3]]:
            keep = a[at]
            a[at] = keep + 1e-2
            up = loss()
            a[at] = keep - 1e-2
            down = loss()
            a[at] = keep
            assert abs((up - down) / 2e-2 - slope[at]) < 2e-2 * max(1, abs(slope[at])), (name, at)


def test_language_model_trains_on_every_document(spark, docs):
    """The weights' sum counts every training token once, whatever the rounds."""
    from pyspark.sql import functions as F

    counts = lm.count_tokens(docs.filter(lm.fold_of(F.col("doc_id")) != 1)).toPandas()
    v = lm.Vocabulary(counts["h"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy(np.int64), int(counts["n"].sum()), len(counts))
    encoded = lm.encode(docs, v)
    assert {low for low, _ in lm.ROUNDS[1:]} == {high for _, high in lm.ROUNDS[:-1]} and lm.ROUNDS[0][0] == 0 and lm.ROUNDS[-1][1] == lm.SLICES
    rows = encoded.filter("training").select(F.octet_length("ranks").alias("n"), "slice").collect()
    assert sum(r["n"] // 4 + 1 for r in rows) == v.tokens and all(0 <= r["slice"] < lm.SLICES for r in rows)
    again = [lm.train(encoded, v).flat() for _ in range(2)]
    assert (again[0] == again[1]).all()


def test_substring_dedup(docs, rows, empty, spark):
    seen, covered = set(), {}
    for i, t in ((r[0], r[1]) for r in rows):
        w = spaced(t)
        grams = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        covered[i] = {j for k, x in enumerate(grams) if x in seen for j in range(k, k + 50)}
        seen |= set(grams)
    got = {}
    for r in substring.repeats(docs).collect():
        assert r["other_id"] < r["doc_id"]
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert all(covered[i] <= got.get(i, set()) for i in covered)
    assert all(covered[i] or any(rows[i][1].split()[:4] == r[1].split()[:4] for r in rows[:i] if r[1] and r[1].split()) for i in got)
    cut = {r["doc_id"]: r for r in substring.without_repeats(docs).collect()}
    assert set(cut) >= {r[0] for r in rows} - set(got)
    assert all(cut[i]["text"] == rows[i][1] for i in cut if i not in got)
    assert all(cut[i]["n_chars"] == len(cut[i]["text"]) for i in cut if i in got)
    assert substring.repeats(empty).collect() == []
    assert substring.without_repeats(empty).collect() == []


def test_substring_dedup_of_edited_passages(spark):
    """Passages of which every fifth word, or a fifth of the words at any place, is replaced."""
    g = random.Random(7)
    texts, at = [], {}
    for i in range(40):
        n = g.choice([50, 60, 100, 200])
        passage = prose(g, n).split()
        other = list(passage)
        for j in range(4, n - 1, 5) if i % 2 else g.sample(range(1, n - 1), n // 8):
            other[j] = f"x{g.randrange(10**6)}"
        texts += [" ".join([prose(g, 30), *passage, prose(g, 30)]), " ".join([prose(g, 25), *other, prose(g, 40)])]
        at[2 * i + 1] = (25, 25 + n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in substring.repeats(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(got) == set(at)
    assert all(len(got[i] & set(range(a, z))) >= 0.9 * (z - a) for i, (a, z) in at.items())


def test_substring_dedup_in_stock_phrases(spark):
    """Texts of 50 phrases of 14 words; 20 hold a passage of another with up to a fifth of its words replaced. Most documents that share a seed don't hold the passage."""
    g = random.Random(1)
    phrases = [[f"v{g.randrange(2000)}" for _ in range(14)] for _ in range(50)]
    texts = [[w for _ in range(g.randint(8, 14)) for w in g.choice(phrases)] for _ in range(300)]
    for i in range(200, 300, 5):
        source = texts[g.randrange(150)]
        a = g.randrange(len(source) - 80)
        passage = source[a : a + 80]
        for j in g.sample(range(1, 79), 12):
            passage[j] = f"x{g.randrange(10**6)}"
        texts[i] = texts[i][:40] + passage + texts[i][40:]
    got = {}
    for r in substring.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect():
        assert r["other_id"] < r["doc_id"] and r["agree"] >= 0.8 * (r["end"] - r["start"]) >= 40
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    found = [i for i in range(200, 300, 5) if len(got.get(i, set()) & set(range(40, 120))) >= 64]
    assert len(found) >= 19


def test_substring_dedup_ships_where_holders_change(spark):
    """Six documents hold a phrase of 40 words, three of them 20 words more: of its 37 and 57 seeds those go to the second pass at which the holders change."""
    phrase = [f"p{i}" for i in range(60)]
    texts = [[f"a{i}_{j}" for j in range(30)] + phrase[: 60 if i < 3 else 40] + [f"b{i}_{j}" for j in range(30)] for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc"]: r["parts"] for r in substring.chained(substring.anchors(docs, 5), need=6).filter("doc = other").collect()}
    assert set(rows) == set(range(6))
    for i, (places, turns) in rows.items():
        at = np.cumsum(substring._unpack(places, np.uint32)).astype(np.int64)
        turns = np.unpackbits(np.frombuffer(turns, np.uint8), count=len(at)).astype(bool)
        assert at.tolist() == list(range(30, 87 if i < 3 else 67))
        assert at[turns].tolist() == ([30, 67] if i < 3 else [30])
        got = substring._around(i, np.arange(len(texts[i]), dtype=np.uint64), at, turns, [], 50)
        assert got["at"][got["first"] > 0].tolist() == at[turns].tolist()
        assert got["at"][got["last"] > 0].tolist() == ([66, 86] if i < 3 else [66])
        assert got["at"][got["whole"] > 0].tolist() == ([30] if i < 3 else [])
        assert len(got) <= 4


@pytest.mark.parametrize("flank", [30, 120])
def test_substring_dedup_inside_half_equal_text(spark, flank):
    """Around 60 equal words three words agree and three differ in turn."""
    g = random.Random(flank)
    a = [f"a{i}" for i in range(2 * flank + 60)]
    b = [w if flank <= i < flank + 60 or (i - flank) % 6 >= 3 else f"b{i}" for i, w in enumerate(a)]
    docs = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b)), (2, prose(g, 300))], "doc_id long, text string")
    got = substring.repeats(docs).collect()
    assert {r["doc_id"] for r in got} == {1}
    assert set(range(flank, flank + 60)) <= {i for r in got for i in range(r["start"], r["end"])}
    assert all(r["end"] - r["start"] >= 50 and r["agree"] >= 0.8 * (r["end"] - r["start"]) for r in got)


def test_stretches_against_brute_force():
    g = random.Random(5)
    for _ in range(200):
        p, runs, i = g.choice([0.6, 0.75, 0.85]), [], 0
        on = [g.random() < p for _ in range(g.choice([20, 60]))]
        runs = [(i, i + 3, 1) for i, x in enumerate(on) if x]
        want = {i for s in range(len(on)) for e in range(s + 10, len(on) + 1) if on[s] and on[e - 1] and sum(on[s:e]) >= 0.8 * (e - s) - 1e-9 for i in range(s, e)}
        got = list(substring.stretches(runs, 10, 0.8)) if runs else []
        assert {i for r in got for i in range(r[0], r[1])} == want
        assert all(r[1] - r[0] >= 10 and r[4] == sum(on[r[0] : r[1]]) >= 0.8 * (r[1] - r[0]) - 1e-9 for r in got)


def test_chains_against_brute_force():
    g = np.random.default_rng(3)
    for _ in range(30):
        n = int(g.integers(1, 9))
        parts = np.stack([g.integers(0, 60, n), g.integers(0, 60, n), g.integers(6, 20, n)], 1)
        parts = np.unique(parts, axis=0)

        def best(i):
            s, o, w = parts[i]
            rest = [best(j) - 0.1 * ((s - parts[j][0] - parts[j][2]) + (o - parts[j][1] - parts[j][2])) for j in range(len(parts)) if parts[j][0] + parts[j][2] <= s and parts[j][1] + parts[j][2] <= o]
            return w + max([0, *rest])

        chain = substring.chains(parts)[0]
        score = chain[:, 2].sum() - 0.1 * sum((b[0] - a[0] - a[2]) + (b[1] - a[1] - a[2]) for a, b in zip(chain[:-1], chain[1:], strict=True))
        assert abs(score - max(best(i) for i in range(len(parts)))) < 1e-9


def test_decontamination(spark, empty):
    g = random.Random(6)
    items = [(i, prose(g, n)) for i, n in enumerate([3, 5, 7, 12, 14, 30, 33, 64, 120, 300])] + [(20, None), (21, ""), (22, "Two words")]
    texts = []
    for i, t in items[:10]:
        w = t.split()
        texts += [prose(g, 900) + " " + t.upper().replace(" ", ", ") + ". " + prose(g, 400), t, " ".join(w[: len(w) // 2]), prose(g, 50) + " " + " ".join(w[: -len(w) // 8 or None])]
    texts += [None, "", "now two words here", prose(g, 3000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shared string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        w = alnum(t)
        for i, item in items:
            q = alnum(item)
            k = min(5, len(q))
            a = shingles(q)
            if a and len(a & shingles(w, k) if len(w) >= k else set()) >= 0.8 * len(a) - 1e-9:
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == want and len(want) > 20
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.leaks(empty, bench).collect() == [] and decontaminate.leaks(docs, bench.limit(0)).collect() == []
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(texts)


def test_source_mix(spark, rows, docs, empty):
    got = mixing.mix(docs).collect()
    size = {r[0]: len(spaced(r[1])) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(by.values()), set()
    while True:
        left = total - sum(3 * by[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped) if len(capped) < len(names) else 0
        more = {s for s in names if s not in capped and weight[s] * level > 3 * by[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * by[s] if s in capped else weight[s] * level for s in names}
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["key"]] and r["source_size"] == by[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["epochs"] * r["size"] and 0 <= r["epochs"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], 1) for s in names)
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r["key"], r["taken"]) for r in got} == {(r["key"], r["taken"]) for r in again}
    assert mixing.mix(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b", "x", 7, 8), (1, "a b", "x", 7, 8), (None, None, None, 7, 8)], "doc_id long, text string, source string, epochs int, row int")
    assert mixing.mix(odd, rows=True).filter("size > 0").count() == 2


    out = mixing.stage(spark, odd, "")  # columns of the results' names
    assert out.columns == ["doc_id", "text", "source", "row", "epochs", "taken"] and {r["taken"] for r in out.collect()} <= {2, 4, 6}


def test_source_mix_of_shared_texts(spark):
    """Texts that two sources hold are spread over both, so that fewer texts are taken twice than by a mix of each source alone."""
    g = random.Random(3)
    shared = [prose(g, 50) for _ in range(300)]
    rows = [(i, t, "a") for i, t in enumerate(shared)] + [(1000 + i, t, "b") for i, t in enumerate(shared)] + [(2000 + i, prose(g, 50), "c") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1.0, 1.0, 8.0)).collect()
    taken, texts = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        texts[r["key"] % 1000 if r["key"] < 2000 else r["key"]] += r["epochs"]
        assert r["pattern"] == ('[{"source":"a"},{"source":"b"}]' if r["key"] < 2000 else '[{"source":"c"}]')
    target = {r["source"]: r["target"] for r in got}
    assert all(abs(taken[s] - target[s]) <= 50 for s in "abc") and target["a"] == target["b"] == 7500
    # a and b take half of the shared texts each: not one of them is taken by both
    assert sum(n > 1 for t, n in texts.items() if t < 1000) <= 2
    few = mixing.mix(docs, weights=(1.0, 1.0, 8.0), most_patterns=0).collect()  # all shared patterns in one
    assert sum(r["taken"] for r in few) == pytest.approx(sum(taken.values()), abs=200)


def test_fill_up():
    assert mixing.fill_up(0.0, []) == [] and mixing.fill_up(0.4, [(1, "a")]) == [] and mixing.fill_up(0.6, [(1, "a")]) == ["a"]
    assert mixing.fill_up(13.0, [(8, "a"), (8, "b"), (4, "c"), (1, "d"), (1, "e")]) == ["a", "c", "d"]
    assert mixing.fill_up(100.0, [(3, "a"), (5, "b")]) == ["b", "a"]


def test_min_cost_flow():
    # two sources, one shared pattern: the shared words go where they are short, and repetition starts only when they are used up
    flow = mixing.min_cost_flow([100, 100, 50], [{0: 300}, {1: 300}, {0: 150, 1: 150}], [120, 130])
    assert abs(flow[0][0] - 100) < 1e-6 and abs(flow[1][1] - 100) < 1e-6 and abs(flow[2][0] - 20) < 1e-6 and abs(flow[2][1] - 30) < 1e-6
    assert abs(sum(sum(r.values()) for r in mixing.min_cost_flow([10], [{0: 30}], [100])) - 30) < 1e-6


def test_min_cost_flow_against_brute_force():
    import itertools

    g = random.Random(4)
    for _ in range(40):
        once = [g.randrange(1, 3) for _ in range(3)]
        limits = [{s: g.randrange(0, 4) for s in range(2) if g.random() < 0.8} for _ in range(3)]
        quota = [g.randrange(0, 6), g.randrange(0, 6)]
        cells = [(p, s, w) for p, row in enumerate(limits) for s, w in row.items()]
        cost = lambda given, p: sum(k // once[p] for k in range(given))
        best = None
        for x in itertools.product(*(range(w + 1) for _, _, w in cells)):
            if all(sum(v for v, (_, s, _) in zip(x, cells, strict=True) if s == t) <= quota[t] for t in (0, 1)):
                price = (-sum(x), sum(cost(sum(v for v, (q, _, _) in zip(x, cells, strict=True) if q == p), p) for p in range(3)))
                best = min(best or price, price)
        flow = mixing.min_cost_flow(once, limits, quota)
        total = [round(sum(r.values()), 6) for r in flow]
        assert all(abs(t - round(t)) < 1e-6 for t in total)
        assert (-round(sum(total)), sum(cost(round(t), p) for p, t in enumerate(total))) == best


def labelled(spark, n=600):
    g = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        words = prose(g, g.choice([5, 40, 200]), 800).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(g.randrange(len(words)), g.choice(["idiot", "moron", f"qzx{g.randrange(40)}", f"qzx{g.randrange(40)}"]))
        text = " ".join(f"{w}###" for w in words) if junk else " ".join(words)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 2:
            labels.append((i, 0 if junk else 1, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 600
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    right = [r["predicted"] == (r["doc_id"] % 5 == 0) for r in got if r["held_out"]]
    assert sum(right) / len(right) > 0.95
    none = toxicity.train(docs, labels.limit(0))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "idiot moron scum")], "doc_id long, text string")
    assert toxicity.score(odd, none).count() == 4
    assert toxicity.score(empty, none).collect() == []
    toxicity.train(empty, labels)


def test_toxicity_of_long_clean_texts():
    """A text of 200,000 distinct words holds no voter that it doesn't name."""
    model = toxicity.Model(toxicity._lexicon(toxicity.LEXICON))
    clean = " ".join(f"q{i}z" for i in range(200_000))
    v, dense = model.votes(Block(pa.array([clean, clean + " idiot", "idiot scum"]), ALNUM))
    assert v[0, :-5].sum() == 0 and dense[0, 0] == 0
    assert v[1, :-5].sum() == 1 and v[2, :-5].sum() == 2


def test_toxicity_mines_all_labelled_rows(spark):
    docs = spark.createDataFrame([(i, f"plain words here {'zorblat' if i % 10 == 0 else 'calm'}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    assert toxicity._lexicon(("zorblat",))[0] in toxicity.train(docs, labels).terms


def test_votes_outvote_a_given_label(spark):
    """Rows full of insults that are labelled clean are taught as toxic ones, and the classifier learns from rows without labels."""
    g = random.Random(11)
    bad = ["idiot", "moron", "scum", "vermin", "filth", "trash"]
    rows, labels = [], []
    for i in range(500):
        words = prose(g, 60).split() + (g.sample(bad, 4) if i % 5 == 0 else [])
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            labels.append((i, 0 if i in (20, 40, 60) else int(i % 5 == 0)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, given)
    v, _ = model.votes(Block(pa.array([rows[20][1], rows[21][1]]), ALNUM))
    post = model.odds(v, np.array([0.0, np.nan]))
    assert post[0] > 0 > post[1]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == int(i % 5 == 0) for i in got)
    # without labels for the lexicon's rows the classifier still has rows to learn from
    assert model.linear is not None


def test_quality(spark, empty):
    docs, labels = labelled(spark)
    got = quality.assess(docs, labels).collect()
    wrong = [r for r in got if (r["posterior"] >= 0.5) != (r["doc_id"] % 7 != 0)]
    assert len(got) == 600 and len(wrong) <= 12
    assert quality.assess(empty, labels).collect() == []
    assert all(r["posterior"] >= 0.5 for r in quality.assess(docs, labels.limit(0)).collect())
    odd = spark.createDataFrame([(None, None, None, None, 1, 2), (1, "", None, "s", 1, 2), (1, "", None, "s", 1, 2)], "doc_id long, text string, lang string, source string, evidence int, host int")
    out = quality.assess(odd, labels, columns=odd.columns, prefix="__")
    assert out.count() == 3 and set(odd.columns) <= set(out.columns)


def test_sites_shrink_toward_their_host(spark):
    rows = [("big", f"p{i % 2}", 4.0 if i % 10 else -4.0) for i in range(400)] + [("big", "rare", -4.0)] + [("bad", "p", -4.0)] * 60
    found = quality.sites(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.0)
    got = {(r["host"], r["path"]): r["prior"] for r in found.withColumn("prior", quality.prior_without(0.0)).collect()}
    assert got["bad", "p"] < got["big", "rare"] < got["big", "p1"] and got["bad", "p"] < got["big", "p0"] < got["big", "p1"]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 200)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    item = docs.filter("doc_id = 13").head()["text"]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert out.columns[:5] == now.columns[:5] and (i == len(corpus_pipeline.STAGES) - 1 or out.columns == now.columns)
        out.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
    kept = {r["doc_id"] for r in now.collect()}
    assert kept and 13 not in kept and not any(i % 7 == 0 for i in kept if i < 100 and i % 2)


def test_columns_of_any_name(spark):
    """Stages keep columns that are called like their own helpers."""
    g = random.Random(12)
    passage = prose(g, 80)
    names = ["doc_id", "text", "lang", "source", "n_chars", "__evidence", "__posterior", "evidence", "host", "path", "row", "__spans", "__doc", "__gone", "epochs", "taken", "n", "mean"]
    rows = [(i, f"{prose(g, 60)} {passage if i % 10 == 0 else ''} {prose(g, 30)}", "en", "s", 5, *["x"] * (len(names) - 5)) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality.assess(docs, labels, columns=docs.columns, prefix="q_")
    assert out.columns == [*names, "q_evidence", "q_site_prior", "q_posterior"] and out.count() == 40
    cut = substring.without_repeats(docs)
    assert cut.columns == names and {r["__spans"] for r in cut.collect()} == {"x"} and cut.count() == 40
    assert jaccard.stage(spark, docs, "").columns == names and jaccard.stage(spark, docs, "").count() == 40
    mixed = mixing.stage(spark, docs, "")
    assert set(mixed.columns) == set(names) and mixed.head()["row"] == "x" and mixed.head()["taken"] > 1
    assert decontaminate.clean(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).count() == 36


def test_long_texts_and_odd_ids(spark):
    """A text of 20 MB, null ids and repeated ids through every operator."""
    g = random.Random(13)
    long = prose(g, 3_000_000, 50_000)
    item = " ".join(long.split()[2_000_000:2_000_040])
    rows = [(1, long), (2, f"start {item} end"), (None, item), (None, None), (3, "a b c"), (3, "a b c"), (4, "")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((str(r["doc_id"]), r["shared"]) for r in decontaminate.leaks(docs, bench).collect()) == [("1", 36), ("2", 36), ("None", 36)]
    assert fingerprint.fingerprints(docs).count() == 7 and quality.assess(docs, labels).count() == 7
    assert licenses.scan(docs).agg({"n_words": "max"}).head()[0] == 3_000_000
    scores = lm.lm_scores(docs).collect()
    assert max(r["n_tokens"] for r in scores) == 3_000_001 and len(scores) == 7
    assert mixing.mix(docs).agg({"size": "max"}).head()[0] == 3_000_000
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 7
    assert jaccard.jaccard_components(docs).agg({"n_shingles": "max"}).head()[0] > 2_900_000
    assert [(r["doc_id"], r["other_id"]) for r in substring.repeats(docs).collect()] == []
    longer = spark.createDataFrame([(1, long), (2, " ".join(long.split()[2_000_000:2_000_060]))], "doc_id long, text string")
    assert [(r["doc_id"], r["start"], r["end"], r["other_start"]) for r in substring.repeats(longer).collect()] == [(2, 0, 60, 2_000_000)]


def test_sketches_of_blocks_are_the_same_dense_or_sparse(monkeypatch):
    g = random.Random(14)
    block = Block(pa.array([prose(g, g.choice([3, 12, 80, 700])) for _ in range(60)]), ALNUM)
    grams, at = block.grams(5)
    cut = np.searchsorted(at, block.first)
    doc = np.repeat(np.arange(block.n), np.diff(cut))
    place = np.arange(len(grams)) - cut[:-1][doc]
    for size in (16, 128, 4096):
        got = []
        for dense in (1 << 40, 0):
            monkeypatch.setattr(decontaminate, "DENSE", dense)
            owner, value = decontaminate.Items._sketches(grams, doc, place // size, np.diff(cut), size, 8 * size)
            got.append(sorted(zip(owner.tolist(), value.tolist(), strict=True)))
        assert got[0] == got[1]


def test_ranges_of_ids_with_gaps(spark, monkeypatch):
    """Dense ids and one far away: no range takes them all, and each row meets the next one."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "BUCKET", 20)
    ids = [*range(1000), *range(5000, 5100), 2**50, -(2**40)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["text"] for r in fingerprint.with_next(docs, ["text"]).collect()}
    order = sorted(ids)
    assert got == {i: f"t{n}" for i, n in zip(order, [*order[1:], order[0]], strict=True)}


def test_license_blocks_are_returned(spark):
    text = licenses.TEMPLATES["isc"]
    docs = spark.createDataFrame([(1, f"{prose(random.Random(1), 100)} {text} {prose(random.Random(2), 100)}"), (2, "nothing")], "doc_id long, text string")
    got = licenses.blocks(docs).collect()
    assert got and all(r["doc_id"] == 1 and r["start"] < 100 + len(alnum(text)) and r["end"] > 100 for r in got)
    assert max(r["containment"] for r in got if r["label"] == "isc") == 1.0
