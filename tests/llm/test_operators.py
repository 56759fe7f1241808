"""Each operator on small tables: brute force, odd values, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import embed_join, fertility, langid, mixing, ngram_join, packing, quality, sanitise, tokenbin, toxicity
from pixelweave.llm.common import ship_by_value, table, written
from pixelweave.llm.components import components

ship_by_value()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, component string, _row int"
PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing in that old green tree by river number"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, s, 0, "x", "y", "z", 7) for i, t, g, s in rows], SCHEMA)


def odd_rows():
    words = PROSE.split()
    text = lambda k: " ".join(words[(k * 7 + j * j) % len(words)] + str((k * j) % 13) for j in range(60))
    rows = [(k, text(k), ["en", "de", None][k % 3], ["a", "b", "ü", None][k % 4]) for k in range(24)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t", "en", "a"), (103, "word " * 30_000, "en", "b"), (None, "no id at all", "en", "b"), (104, text(1), "en", "a"), (5, text(5), "de", "b"), (105, "mail me: someone@example.org or +1 (234) 555-7890", "en", "a")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_rows()).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(24)] + [(3, None, None), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]


def test_mix(spark, odd):
    rows = odd_rows()
    got = mixing.mix_plan(odd).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(sizes(rows))
    by = defaultdict(int)
    for (_, _, _, s), n in zip(rows, sizes(rows)):
        by[s] += n
    order = sorted((s for s in by if s is not None)) + [None]
    w, held = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while True:  # brute force: hold what is above, share the rest
        level = (sum(by.values()) - sum(held.values())) / max(1e-9, sum(w[s] for s in order if s not in held))
        more = {s: 3 * by[s] for s in order if s not in held and w[s] * level > 3 * by[s]}
        if not more:
            break
        held |= more
    want = {s: held.get(s, w[s] * level) for s in order}
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == by[r["source"]] and np.isclose(r["target"], want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in ("ü", None):  # sources of many like documents
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix_plan(odd.repartition(5)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and sum(sizes([r[:4] for r in out.collect()])) == sum(taken.values())


def test_token_files(spark, odd, tmp_path):
    path = str(tmp_path / "tokens")
    tokenbin.write_token_files(odd, path)
    got = tokenbin.read_token_files(spark, path, with_ids=True).collect()
    tok = tokenbin.tokenizer(tokenbin.vocabulary_path()).tok
    ids = sorted(((i is not None, i or 0), [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _, _ in odd_rows())
    have = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids"]) for r in got)
    assert have == ids
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(i if i is not None else -1 for i, _, _, _ in odd_rows())


def test_pack(spark, odd):
    got = packing.pack(odd, with_ids=True).persist()
    rows = got.collect()
    tok = tokenbin.tokenizer(tokenbin.vocabulary_path()).tok
    total = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in odd_rows())
    assert sum(r["length"] for r in rows) == total
    by = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] <= 2048
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 103)
    assert len(long) > 2 and all(n == 2048 for _, _, n in long[1:]) and long[0][1] == 0
    assert sum(len(r["tokens"]) for r in packing.sequences(got).collect()) == total and len(by) <= total / 2048 * 1.2 + 1


def test_fertility(odd):
    got = {(r["doc_id"], r["n_words"]): r for r in fertility.judge(odd).collect()}
    for (i, t, _, _), n in zip(odd_rows(), sizes(odd_rows())):
        r = got[i, n]
        assert r["base_failed"] == (n < 20 or 100 * r["n_repeat_words"] > 30 * n) and not (r["kept"] and r["base_failed"])
    assert got[103, 30_000]["n_repeat_words"] == 30_000 and got[1, 60]["kept"]


def test_fertility_of_rare_languages(spark):
    words = PROSE.split()
    rng = np.random.default_rng(0)
    prose = lambda k: " ".join(rng.choice(words, 40 + k % 9))
    junk = lambda k: " ".join(f"{(k + j) * 7919 % 99991:x}#{j * k:o}\x07" for j in range(40))
    rows = [(k, prose(k), "en", "a") for k in range(300)] + [(1000 + k, prose(k), "rare", "a") for k in range(5)] + [(2000, junk(3), "rare", "a"), (2001, junk(4), "alone", "a"), (2002, junk(5), "en", "a")]
    got = {r["doc_id"]: r for r in fertility.judge(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows) and not any(got[k]["base_failed"] or got[k]["kept"] for k in (2000, 2001, 2002))
    assert all(got[k]["kept"] == (not got[k]["base_failed"]) for k in range(1000, 1005)) and any(got[k]["kept"] for k in range(1000, 1005))


def test_language(spark):
    en, de = "the cat sat on the mat and the dog ran after it through the house", "der hund lief nach dem mann und die frau ging durch das haus"
    rows = [(k, en if k % 2 else de, "en" if k % 2 else "de", None) for k in range(12)] + [(20, "the house and the dog", None, None), (21, "das haus und der mann", None, None), (22, "12 !", "de", None), (23, None, "en", None), (24, "", None, None)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, rows)).collect()}
    assert [got[k]["lang_pred"] for k in (0, 1, 20, 21, 22, 23, 24)] == ["de", "en", "en", "de", "und", "und", "und"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def test_every_language_is_learned(spark):
    names = [f"l{k:03d}" for k in range(405)]
    word = lambda k, j: "".join(chr(0x4E00 + k * 8 + (j * 3 + i) % 8) for i in range(3))
    rows = [(k, " ".join(word(k, j) for j in range(6)), n, None) for k, n in enumerate(names)]
    rows += [(1000 + k, "common words", "l000", None) for k in range(3)] + [(2000, "1 " * 4000 + "zwei", "late", None), (2001, "zwei", None, None)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(spark, rows)).collect()}
    assert [got[k]["lang_pred"] for k in range(405)] == names and got[2001]["lang_pred"] == "late" and all(0 <= r["score"] <= 1 for r in got.values())


def test_sanitise(spark, odd):
    got = sanitise.report(odd).collect()
    r = next(r for r in got if r["doc_id"] == 105)
    assert (r["n_email"], r["n_phone"]) == (1, 1) and len(got) == len(odd_rows())
    assert r["base_sha256"] == hashlib.sha256(b"email:9:28,phone:32:49").hexdigest() and r["spans"] == "email:9:28,phone:32:49"
    clean = sanitise.sanitised(odd)
    assert clean.columns == odd.columns and next(x["text"] for x in clean.collect() if x["doc_id"] == 105) == "mail me: [EMAIL] or [PHONE]"


def test_terms_that_reveal(spark):
    filler = [f"plain words number{k} about weather and bread" for k in range(60)]
    known = [f"note{k} that Zaphod wrote to zb@example.org about {w}" for k, w in enumerate("tea coffee milk water".split())]
    docs = docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(filler + known)])
    rows = {r["doc_id"]: r["spans"] for r in sanitise.report(docs).collect()}
    assert all("remove:11:17" in rows[60 + k] for k in range(4)) and not any("about" in (rows[k] or "") for k in range(60)) and rows[0] == ""
    assert "Zaphod" not in " ".join(r["text"] for r in sanitise.sanitised(docs).collect())
    copies = docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(filler + [known[0]] * 9)])
    assert not any("remove" in r["spans"] for r in sanitise.report(copies).collect())


def test_each_row_loses_its_own_terms(spark):
    filler = [(k, f"plain words number{k} about weather and bread") for k in range(60)]
    known = [(60, "early that Zaphod wrote to zb@example.org about tea"), (60, "Zaphod then asked zb@example.org about coffee"), (None, "milk that Zaphod got from zb@example.org there"), (60, "nobody wrote to else@example.org about bread"), (60, "early that nobody sent to zb@example.org about tea")]
    known += [(70 + k, f"again Zaphod wrote to zb@example.org about {w}") for k, w in enumerate("water juice wine".split())]
    rows = filler + known
    spans = {r["doc_id"]: r["spans"] for r in sanitise.report(docs_of(spark, [(k, t, "en", "a") for k, (_, t) in enumerate(rows)])).collect()}
    want = [sanitise.replaced(t, spans[k].split(",")) if spans[k] else t for k, (_, t) in enumerate(rows)]
    clean = [r["text"] for r in sanitise.sanitised(docs_of(spark, [(i, t, "en", "a") for i, t in rows])).collect()]
    assert sorted(clean) == sorted(want) and not any("Zaphod" in t for t in clean)


def test_terms_anywhere_in_the_text(spark):
    between = "these are more plain words about weather and bread than six"
    filler = [f"plain words number{k} {between}" for k in range(60)]
    known = [f"Kim of {w} {between} zb@example.org {between} KIM" for w in "tea coffee milk water".split()]
    runs = [f"{w}\u738b\u5c0f\u660e{between} cd@example.org" for w in "\u8336 \u6c34 \u5976 \u9152".split()]
    texts = filler + known + runs + ["Kim alone"]
    rows = {r["doc_id"]: r["spans"] for r in sanitise.report(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    for k in range(60, 64):
        assert {f"generalise:{m.start()}:{m.end()}" for m in re.finditer("Kim|KIM", texts[k])} <= set(rows[k].replace("remove", "generalise").split(","))
    clean = [r["text"] for r in sanitise.sanitised(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()]
    assert [t for t in clean if "kim" in t.lower()] == ["Kim alone"] and not any("\u5c0f" in t for t in clean)


def test_terms_of_an_entity_in_one_text(spark):
    filler = [f"plain words about weather and bread, number {k % 20}" for k in range(400)]
    texts = [f"{t} of {k // 20}" for k, t in enumerate(filler)] + ["plain words about Zaphod and zb@example.org"] * 5 + ["bread and cd@example.org, Trillian", "weather: cd@example.org or Trillian"]
    rows = [r["spans"] for r in sanitise.report(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]).coalesce(1)).collect()]
    assert [r for r in sorted(rows) if r] == sorted(["remove:18:24,email:29:43"] * 5 + ["email:10:24,remove:26:34", "email:9:23,remove:24:26,remove:27:35"])


def brute_components(links, ids):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(edges, {x for e in edges for x in e})
    assert all(got.get(i, i) == c for i, c in want.items())


def near_texts():
    rng = np.random.default_rng(4)
    texts = {}
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for k in range(7):
            words = list(base)
            for _ in range(k % 4):
                words[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10**6)}"
            texts[g * 10 + k] = " ".join(words)
    texts |= {90: "a b", 91: "A  b", 92: "", 93: None, 94: "a b c d e", 95: "a b c d e"}
    return texts


def brute_join(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, brute_components(links, sets)


def test_join_and_choice(spark):
    texts = near_texts()
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in texts.items()])
    sets, want = brute_join(texts)
    got = {r["doc_id"]: r for r in ngram_join.join(docs).collect()}
    assert {i: (len(sets[i]), want[i]) for i in texts} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({want[i] for i in texts})


def test_join_of_repeated_and_missing_ids(spark):
    texts = near_texts()
    rows = [(7, texts[0]), (7, texts[0]), (7, texts[30]), (31, texts[31]), (3, texts[1]), (None, texts[1]), (None, texts[40]), (None, texts[40]), (None, None), (None, None), (50, ""), (50, "")]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((r["doc_id"] or 0, r["n_shingles"] > 0, r["component_id"] or 0) for r in ngram_join.join(docs).collect())
    assert got == sorted([(7, True, 3)] * 3 + [(31, True, 3), (3, True, 3), (0, True, 3)] + [(0, True, 0)] * 2 + [(0, False, 0)] * 2 + [(50, False, 50)] * 2)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, texts[1]), (None, texts[40]), (None, None), (None, None), (50, ""), (50, "")], key=str)


@pytest.mark.parametrize("block, frequent, flush", [(3, 32, 1 << 20), (2, 2, 64), (1024, 2, 256)])
def test_join_in_blocks(spark, monkeypatch, block, frequent, flush):
    texts = near_texts()
    for name, value in (("BLOCK", block), ("FREQUENT", frequent), ("FLUSH", flush)):
        monkeypatch.setattr(ngram_join, name, value)
    _, want = brute_join(texts)
    got = ngram_join.join(docs_of(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("block", [1024, 20])
def test_embedding_join(spark, monkeypatch, block):
    monkeypatch.setattr(embed_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:20] + 0.08 * rng.normal(size=(20, 16)), base[:10] + 0.2 * rng.normal(size=(10, 16)), base[:3]])
    rows = [(k, v.tolist(), k % 30 % 2) for k, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 0), (904, x[0].tolist(), None), (905, [], 0), (906, [1.0, 2.0], 0), (907, [float("inf")] * 16, 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit("clash"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    links = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]
    want = brute_components(links, range(len(x)))
    got = {r["vec_id"]: r for r in embed_join.join(vectors).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[k]["n_links"] == near[k].sum() - 1 and got[k]["component_id"] == want[k] and got[k]["kept"] == (want[k] == k) for k in range(len(x)))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k, _, _ in odd)


def test_embedding_ids_that_repeat(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 16))
    rows = [(1, x[0].tolist(), "a"), (1, x[1].tolist(), "a"), (2, x[0].tolist(), "a"), (3, (x[1] + 0.02 * rng.normal(size=16)).tolist(), "a"), (4, x[0].tolist(), "b"), (None, x[0].tolist(), "a")]
    got = embed_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_embedding_recall_in_cells(spark, monkeypatch):
    monkeypatch.setattr(embed_join, "CELL", 128)
    rng = np.random.default_rng(1)
    u = embed_join.unit(rng.normal(size=(3000, 24)))
    v = rng.normal(size=u.shape)
    v -= (u * v).sum(1)[:, None] * u
    w = 0.932 * u + np.sqrt(1 - 0.932**2) * embed_join.unit(v)  # a pair each, just above the threshold
    x = np.concatenate([u, w]).astype(np.float32)
    assert embed_join.calibrate(6000)[0] >= 5 and embed_join.calibrate(6000)[2] >= 8
    rows = spark.createDataFrame([(k, y.tolist(), 1) for k, y in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embed_join.join(rows).collect()}
    z = embed_join.unit(x.astype(float))
    want = (z @ z.T >= 0.93).sum(1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert want.sum() >= 6000 and (found <= want).all() and found.sum() >= 0.998 * want.sum()


def test_classifiers_on_odd_rows(odd, labels):
    for scored in (toxicity.score(odd, labels), quality.score(odd, labels)):
        rows = scored.collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.accepted(odd, labels).columns == odd.columns


def test_empty_tables(spark, none, labels, tmp_path):
    path = str(tmp_path / "tokens")
    tokenbin.write_token_files(none, path)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    made = [mixing.mix_plan(none), mixing.mixed(none), tokenbin.read_token_files(spark, path), packing.pack(none), fertility.judge(none), langid.identify(none), sanitise.report(none), sanitise.sanitised(none), embed_join.join(vectors), ngram_join.join(none), ngram_join.one_of_each(none), toxicity.score(none, labels), quality.score(none, labels.limit(0)), toxicity.accepted(none, labels.limit(0))]
    assert all(m.count() == 0 for m in made)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    truth = {r["doc_id"]: r for r in labels.collect()}
    for scored, label, least in ((toxicity.score(docs, labels, toxicity.learnable()), "toxic", 0.9), (quality.score(docs, labels, quality.learnable()), "quality", 0.95)):
        rows = [r for r in scored.collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % (5 if label == "toxic" else 3) == (0 if label == "toxic" else 1)]
        assert np.mean([r["predicted"] == truth[r["doc_id"]][label] for r in rows]) >= least
    named = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = langid.identify(docs, langid.learnable()).collect()
    assert np.mean([r["lang_pred"] == named[r["doc_id"]] for r in found if r["letters"] > 50]) > 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    rows, columns = docs.count(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        if k < 3:
            assert docs.columns == columns and 0.5 * rows < docs.count() <= rows
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
