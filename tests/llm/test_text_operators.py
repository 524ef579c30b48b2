"""The text operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from braidset.llm import common, langid, neartexts, packing, quality, runindex
from braidset.llm.common import components, held_out, running_sum
from braidset.llm.imatch import imatch_fingerprints
from braidset.llm.mixing import mix_documents
from braidset.llm.neartexts import near_text_groups
from braidset.llm.nndescent import all_links, audit_recall, near_vectors
from braidset.llm.packing import Encoder, best_fit_decreasing, pack, packed_documents, sequences, token_pieces
from braidset.llm.runindex import WINDOW, RunIndex, repeated_passages, stretches
from braidset.llm.simhash import Anchors, simhash, simhash_groups
from braidset.llm.tokencount import CountTrie, load_vocabulary, token_counts
from braidset.llm.urltrust import judge_urls
from braidset.session import materialize

BPE = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (None, None), (6, "word " * 40_000), (7, "ünï " * 30)]


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x{rng.randrange(9)}" for _ in range(n))


def test_words_are_looked_up_once_for_many_texts():
    """However often the texts of a slice have a word; ids are the library's, odd words and white space included."""
    asked = []

    class Asked(packing._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    encoder, seen = Encoder(BPE), Asked()
    encoder.tables[id(seen)] = encoder.tables.pop(id(encoder.words))
    encoder.words = seen
    texts = ["the cat and the dog", "", " ", "cat  the", "the\ncat the\n", "a<|endoftext|> the", "dog the cat"] * 40
    got = encoder.encode(pa.array(["not in the slice", *texts]).slice(1))
    assert [x.tolist() for x in got] == [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) and {"the", "cat", "and", "dog"} <= set(asked)
    assert encoder.hits[seen["the"]] == 40 * 4


# ---------------------------------------------------------------- shared parts
def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect():
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(61)), list(range(100, 160)), [200, 201, 202]]
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 4 else f"g{i % 8}", i, i % 7) for i in range(800)]
    got = {r["i"]: r["s"] for r in running_sum(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], ["i"], "v", "s").collect()}
    sums = Counter()
    for g, i, v in rows:
        sums[g] += v
        assert got[i] == sums[g]


# ---------------------------------------------------------------- 1 repeated passages
def brute_cut(rows):
    seen = defaultdict(set)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - WINDOW + 1):
            if i is not None:
                seen[b[p:p + WINDOW]].add(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - WINDOW + 1):
            if i is not None and min(seen[b[p:p + WINDOW]]) < i:
                covered[p:p + WINDOW] = b"\1" * WINDOW
        spans = [(k, len(list(g))) for k, g in itertools.groupby(covered)]
        out.append((i, len(b), sum(k for k, _ in spans), bytes(c for c, m in zip(b, covered) if not m)))
    return sorted(out, key=repr)


def test_run_index_matches_brute_force():
    rng = random.Random(3)
    for _ in range(15):
        base = [bytes(rng.choice(b"ab") for _ in range(140)) for _ in range(3)]

        def segment():
            b, a = rng.choice(base), rng.randrange(30)
            x = bytearray(b[a:a + rng.randrange(50, 110)])
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = rng.choice(b"abc")
            return bytes(x)

        texts = [segment() for _ in range(30)]
        docs = np.array([rng.randrange(100) for _ in texts])
        patterns = [segment() for _ in range(20)] + texts[:5] + [b"zz" * 30]
        index = RunIndex(texts, docs)
        assert len(index.run_start) < index.rows
        length, first = index.first_docs(patterns)
        at = 0
        for p in patterns:
            for i in range(len(p)):
                best = 0
                while best < WINDOW and i + best < len(p) and any(p[i:i + best + 1] in t for t in texts):
                    best += 1
                window = p[i:i + WINDOW]
                holders = [d for t, d in zip(texts, docs) if window in t] if len(window) == WINDOW else []
                assert min(length[at], WINDOW) == best and first[at] == min(holders, default=-1)
                at += 1


def test_repeated_passages(documents):
    rng = random.Random(5)
    shared = [words(rng, 30) for _ in range(6)]
    rows = [(i, " ".join([words(rng, 12), rng.choice(shared), words(rng, 12), rng.choice(shared)[rng.randrange(40):]])) for i in rng.sample(range(500), 60)]
    rows += [(600, "a" * 500), (601, "a" * 70), (602, "ab" * 300), (603, "ab" * 40), (604, "ß" * 60), (605, "ß" * 60), (9, rows[0][1]), (9, rows[0][1]), *EDGES[:5], *EDGES[6:8]]
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in repeated_passages(documents(rows)).collect()), key=repr)
    assert got == brute_cut(rows)
    assert repeated_passages(documents([(1, "x")]).where("false")).count() == 0


def test_places_that_matter(spark, documents, monkeypatch):
    """Only places of shared names are written; a name that fills all that is held is judged like the others."""
    rng = random.Random(8)
    written = {}

    def recorded(df, name, **options):
        table = materialize(df, name, **options)
        written[name] = written.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(runindex, "materialize", recorded)
    assert repeated_passages(documents([(i, f"{i} " + words(rng, 60)) for i in range(9)])).count() == 9
    assert not sum(written.values())

    places = [(n, rng.randrange(3) if n % 3 else 7, rng.choice([n, rng.randrange(6)]), 1, k) for n in range(40) for k in range(rng.choice([1, 2, 5, 90]))]
    table = pa.Table.from_pylist([dict(zip(("name", "digest", "doc_id", "mark", "place"), p)) for p in sorted(places, key=lambda p: p[0])])
    want = set()
    for n, of in itertools.groupby(sorted(places), key=lambda p: p[0]):
        of = list(of)
        low, alike = min(p[2] for p in of), len({p[1] for p in of}) == 1
        if any(p[2] > low for p in of):
            want |= {(n, p[2], p[4], alike) for p in of if not alike or p[2] > low}
    monkeypatch.setattr(runindex, "_JUDGED", 32)
    for size in (1, 7, 1000):
        out = [r for b in runindex._shared(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        got = {(r["name"], r["doc_id"], r["place"], r["alike"]) for r in out if r["alike"] is not None}
        whole = {r["name"] for r in out if r["alike"] is None}
        assert got == {w for w in want if w[0] not in whole}
        assert sorted((r["name"], r["digest"], r["doc_id"], r["mark"], r["place"]) for r in out if r["alike"] is None) == sorted(p for p in places if p[0] in whole)
        assert size == 1000 or whole and all(sum(p[0] == n for p in places) >= 32 for n in whole)


def test_crowded_names_are_judged(documents, monkeypatch):
    """A name with more places than are held at once: alike in all documents, unlike in some, or in one document only."""
    def crowded_only(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("name", "doc_id", "mark", "place")]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, pa.bool_()), batch.column(1)], ["name", "doc_id", "mark", "place", "alike", "digest"])

    monkeypatch.setattr(runindex, "_shared", crowded_only)
    rng = random.Random(9)
    shared = [words(rng, 30) for _ in range(3)]
    rows = [(i, " ".join([words(rng, 12), shared[i % 3], words(rng, 12), shared[i % 2][rng.randrange(40):]])) for i in range(30)]
    rows += [(50, "a" * 500), (51, "a" * 300), (52, "bc" * 400), (53, rows[4][1]), (53, rows[4][1]), (None, rows[4][1])]
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in repeated_passages(documents(rows)).collect()), key=repr)
    assert got == brute_cut(rows)


def test_repeated_passages_of_long_texts(documents, monkeypatch):
    """Texts longer than a slice are cut in pieces; the result is that of the whole text."""
    rng = random.Random(6)
    text = words(rng, 9000)
    rows = [(1, text), (2, "begin " + text[20_000:30_000] + " end"), (3, text[5:] + words(rng, 100)), (None, text), (3, "other " + text[100:400])]
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in repeated_passages(documents(rows)).collect()), key=repr)
    assert got == brute_cut(rows)
    buf = np.frombuffer((text * 3).encode(), np.uint8)
    with monkeypatch.context() as m:
        m.setattr(runindex, "_ROLLED", 4096)
        few = stretches(buf, np.array([len(buf)]))
    assert all((a == b).all() for a, b in zip(few, stretches(buf, np.array([len(buf)]))))
    whole = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.encode()])], ["doc_id", "mark", "text"])
    covers = lambda batches: {at for b in batches for p in b.column(4).to_pylist() for at in range(p >> 8, (p >> 8) + (p & 255))}
    monkeypatch.setattr(runindex, "_SLICE", 10_000)
    assert covers(runindex._placed(iter([whole]))) == set(range(len(text.encode()) - WINDOW + 1))


# ---------------------------------------------------------------- 2 quality
def test_quality_network_learns_and_handles_edges(spark, documents):
    rng = random.Random(2)
    good = [(i, words(rng, rng.randrange(5, 80))) for i in range(300)]
    bad = [(i, words(rng, 10) + " " + "zap " * rng.randrange(10, 40)) for i in range(300, 600)]
    docs = documents(good + bad + [(900, None), (901, ""), (902, "word " * 50_000)])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels)
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, net).collect()}
    held = [r for r in rows.values() if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] < 300) for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[900]["score"] == pytest.approx(rows[901]["score"], abs=1e-6)
    one = quality.train(docs, labels.where("quality = 1"))
    assert all(r["score"] > 0.9 for r in quality.quality_scores(docs, one).collect())
    # Slices and blocks of rows change no score.
    texts = [t.encode() for _, t in good[:20]] + [b"", b"x" * 300_000]
    assert np.allclose(quality.score_texts(net, texts), [quality.score_texts(net, [t])[0] for t in texts], atol=1e-5)
    assert np.allclose(quality.score_texts(net, texts[:6] + [b"", b"abc"]), [plain_score(net, t) for t in texts[:6] + [b"", b"abc"]], atol=1e-5)
    assert quality.quality_scores(docs.where("false"), net).count() == 0
    assert quality.quality_scores(docs, quality.train(docs.where("false"), labels.where("false"))).select("score").distinct().count() == 1
    twice = [r["score"] for r in quality.quality_scores(docs.where("doc_id = 5").unionByName(docs.where("doc_id = 5")), net).collect()]
    assert len(twice) == 2 and twice[0] == twice[1]


def plain_score(net, text):
    """The convolution chunk by chunk: two strides of bytes, one stride further each time, padding behind the end."""
    step, chunks = quality.STRIDE, -(-len(text) // quality.STRIDE) + 1
    padded = [*text, *[256] * (step * (chunks + 1) - len(text))]
    best = np.full(quality.FILTERS, -np.inf)
    for c in range(chunks):
        seen = padded[c * step:(c + 2) * step]
        halves = [np.concatenate([net.embedding[b] for b in seen[h * step:(h + 1) * step]]).astype(float) for h in (0, 1)]
        second = halves[1] @ net.filters[:, quality.FILTERS:] if c + 1 < chunks else 0
        best = np.maximum(best, halves[0] @ net.filters[:, :quality.FILTERS] + second + net.bias)
    return 1 / (1 + np.exp(-(np.maximum(best, 0) @ net.weights + net.offset)))


def test_quality_gradients_lower_the_loss():
    """A step of training against the numeric slope: the loss on the batch falls as the network is fitted."""
    rng = random.Random(9)
    texts = [words(rng, 20).encode() + (b" zap zap" if i % 2 else b"") for i in range(48)]
    labels = np.array([i % 2 for i in range(48)], np.float32)
    loss = lambda net: -np.mean(np.log(np.where(labels == 1, s := quality.score_texts(net, texts), 1 - s) + 1e-9))
    few, many = quality.fit(texts, labels, epochs=1), quality.fit(texts, labels, epochs=30)
    assert loss(many) < loss(few) and loss(many) < 0.1


# ---------------------------------------------------------------- 3 fingerprints
def test_fingerprints_of_edges(documents):
    rows = imatch_fingerprints(documents(EDGES)).collect()
    texts = sorted(((i, t or "") for i, t in EDGES), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = Counter()
    for at, (i, t) in enumerate(texts):
        following = texts[(at + 1) % len(texts)][1]
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    ones = [r for r in rows if r["n_chars"] == 3]
    assert len({r["fingerprint"] for r in ones}) == 1 and sum(r["near_next"] == 1.0 for r in ones) >= 2
    assert imatch_fingerprints(documents(EDGES).where("false")).count() == 0
    single = imatch_fingerprints(documents([(1, "alone at last")])).first()
    assert single["near_next"] == 1.0


# ---------------------------------------------------------------- 4 language
def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(0, 7, 5)
        starts, scores = np.cumsum(lengths) - lengths, rng.normal(0, 3, (lengths.sum(), 3))
        labels = langid.viterbi(scores, starts, lengths, 2.0)
        for a, n in zip(starts, lengths):
            value = lambda p: sum(scores[a + i, p[i]] for i in range(n)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
            if n:
                assert value(labels[a:a + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))))


def test_languages_and_mixed_spans(documents):
    rng = random.Random(4)
    speak = {"xx": lambda n: " ".join("".join(rng.choice(("ba", "du", "ki")) for _ in range(3)) for _ in range(n)),
             "yy": lambda n: " ".join("".join(rng.choice(("ol", "em", "ur")) for _ in range(3)) for _ in range(n)),
             "zz": lambda n: " ".join("".join(rng.choice("абвгд") for _ in range(5)) for _ in range(n))}
    rows = [(i, speak[lang](30), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(500, speak["xx"](40) + " " + speak["zz"](20)), (501, None), (502, "12 34 !"), (503, ""), (505, "½ ² ① Ⅷ ৳ 五"[:9]), (None, speak["yy"](5)), (504, speak["yy"](60_000))]
    docs = documents(rows)
    model = langid.train(docs.where("doc_id < 500"))
    got = {r["doc_id"]: r for r in langid.language_spans(docs, model).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert [s["lang"] for s in got[500]["spans"]] == ["xx", "zz"] and got[500]["spans"][0]["words"] == 40
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0.0 for i in (501, 502, 503, 505))
    assert got[504]["lang_pred"] == got[None]["lang_pred"] == "yy"
    kept = Counter(r["doc_id"] for r in langid.known_language(docs, model, 0.5).collect())
    assert kept == Counter(i for i, r in got.items() if r["lang_pred"] != "und" and r["score"] >= 0.5)
    assert langid.known_language(docs, model).columns == docs.columns and langid.known_language(docs.where("false"), model).count() == 0
    nothing = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.language_spans(docs, nothing).collect()} == {"und"}
    assert langid.known_language(docs, nothing).count() == 0 and langid.language_spans(docs.where("false"), model).count() == 0
    twice = langid.language_spans(docs.where("doc_id = 500").unionByName(docs.where("doc_id = 500")), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_numerals_are_no_letters():
    assert [langid.words_of(t) for t in ("½ ² ①", "Ⅷ", "3c a_b", "année½b")] == [[], [], ["c", "a", "b"], ["année", "b"]]


def test_word_scores_are_sums_of_log_probabilities(documents):
    """n-gram scores against a plain sum over runs of letters, and the narrowing by script."""
    docs = documents([(i, t, l) for i, (t, l) in enumerate([("bad cab dab", "xx"), ("fog gof", "yy"), ("абв вба", "zz")] * 20)])
    model = langid.train(docs)
    scorer = langid._Scorer(model)
    for word in ("bad", "fog", "абв", "c"):
        scorer[word]
    scorer.settle()
    for word, number in scorer.items():
        plain = np.zeros(len(model.langs))
        marked = f"<{word}>"
        for size in range(1, 5):
            for i in range(len(marked) - size + 1):
                found = [b for b, at in langid.gram_buckets([word])][size - 1][i]
                plain += model.scores[found]
        plain += model.scores[[b for b, at in langid.gram_buckets([word])][4][0]]
        allowed = model.allowed[langid.script_of(word[0])]
        best = np.where(allowed, plain / 4, -np.inf).argmax()
        assert scorer.table[number].argmax() == best and scorer.table[number][best] == 0
    assert model.langs[scorer.table[scorer["абв"]].argmax()] == "zz"


def test_held_out_is_the_contract_s_fifth(spark):
    got = {r["id"]: r["h"] for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}


# ---------------------------------------------------------------- 5 token counts
def plain_count(pretoken, vocabulary):
    best, unknown = [(0.0, 0)], min(vocabulary.values()) - 10.0
    for i, letter in enumerate(pretoken):
        size = len(letter.encode())
        ways = [(best[i][0] + size * unknown, best[i][1] - size)]
        ways += [(best[j][0] + vocabulary[pretoken[j:i + 1]], best[j][1] - 1) for j in range(i + 1) if pretoken[j:i + 1] in vocabulary]
        best.append(max(ways))
    return -best[-1][1]


def test_token_counts(documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = load_vocabulary(path)
    trie, rng = CountTrie(vocabulary), random.Random(6)
    samples = ["▁" + "".join(rng.choice("theandingérß漢") for _ in range(rng.randrange(1, 14))) for _ in range(400)] + ["▁the", "▁", "▁internationalization"]
    assert [trie.count(s) for s in samples] == [plain_count(s, vocabulary) for s in samples]
    got = sorted(((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in token_counts(documents(EDGES), path).collect()), key=repr)
    assert got == sorted(((i, len((t or "").split()), sum(plain_count("▁" + w, vocabulary) for w in (t or "").split()[:1]) * (1 if len(set((t or "").split())) == 1 else 0) * len((t or "").split())
                           if len(set((t or "").split())) <= 1 else sum(plain_count("▁" + w, vocabulary) for w in t.split())) for i, t in EDGES), key=repr)
    assert token_counts(documents(EDGES).where("false"), path).count() == 0


# ---------------------------------------------------------------- 6 packing
def test_best_fit_decreasing_is_the_piecewise_one():
    for window, n in ((20, 50), (64, 300), (1024, 2000)):
        for seed in range(8):
            rng = random.Random(seed)
            sizes = [rng.randint(1, window) if rng.random() < 0.7 else rng.randint(1, max(1, window // 8)) for _ in range(n)]
            left, opened = [], 0
            for s in sorted(sizes, reverse=True):
                i = bisect.bisect_left(left, s)
                rest = (left.pop(i) if i < len(left) else window) - s
                opened += i == len(left) and rest == window - s
                if rest:
                    bisect.insort(left, rest)
            fill, seen = {}, Counter()
            for s, lo, hi, each, first, offset in best_fit_decreasing(dict(Counter(sizes)), window):
                for i in range(lo, hi + 1):
                    q, o = first + (i - lo) // each, offset + (i - lo) % each * s
                    assert fill.get(q, 0) == o and o + s <= window
                    fill[q] = o + s
                    seen[s] += 1
            assert seen == Counter(sizes) and sorted(window - v for v in fill.values() if v < window) == left


def test_packing_round_trip(documents):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randrange(1, 900))) for i in range(40)] + EDGES + [(50, "a  b\n c"), (51, " lead"), (52, "tail "), (53, "<|endoftext|> x"), (54, "a <|endoftext|>b  c"), (55, "<|endoftext|>")]
    docs = documents(rows)
    pieces = token_pieces(docs, BPE)
    packed = pack(pieces, ["doc_id", "start"])
    got = packed.collect()
    by_place = defaultdict(list)
    for r in got:
        by_place[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in by_place.values():
        end = 0
        for offset, length, ids in sorted(parts):
            assert offset == end and len(ids) == 4 * length
            end += length
        assert end <= 1024
    whole = defaultdict(list)
    for r in got:
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    library = Tokenizer.from_file(BPE)
    for i, t in rows:
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = sorted(whole[i, len(want) // 4])
        assert want in (b"".join(p for _, p in parts), b"".join(dict(parts)[s] for s in sorted(dict(parts))))
    windows = sequences(packed).collect()
    assert sum(r["n_tokens"] for r in windows) == sum(r["length"] for r in got)
    assert all(len(r["ids"]) == (4 * r["n_tokens"] if r["n_tokens"].bit_count() == 1 else 4096) for r in windows)
    digest = packed_documents(docs, BPE).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in digest) == Counter((r["doc_id"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in got)
    assert packed_documents(docs.where("false"), BPE).count() == 0


# ---------------------------------------------------------------- 7 mixing
def test_mixing_meets_its_targets(documents):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(400)] + [(r[0], r[1], "en", "edge") for r in EDGES[:6]]
    docs = documents(rows)
    got = mix_documents(docs).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in mix_documents(docs.repartition(5)).collect())
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    assert mix_documents(docs.where("false")).count() == 0


# ---------------------------------------------------------------- 8 embeddings
def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 16))
    near = base[:40] + 0.05 * rng.normal(size=(40, 16))
    dense = base[50] + 0.05 * rng.normal(size=(90, 16))
    vectors = [list(map(float, v)) for v in (*base, *near, *dense)] + [list(map(float, 3 * base[7])), list(map(float, base[7])), [0.0] * 16, [], None, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(vectors)) + [(None, vectors[3])]
    df = spark.createDataFrame([(i, v, 0, i) for i, v in rows], "vec_id long, embedding array<double>, label int, block long")
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    links = [0] * len(rows)
    parent = list(range(len(rows)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if ok[a] and ok[b] and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.9:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    for n, (i, _) in enumerate(rows):
        want = rows[root(n)][0]
        assert (got[i]["n_links"], got[i]["component_id"]) == (links[n], want) and got[i]["kept"] == (i is not None and i == want)
    assert near_vectors(df.where("false")).count() == 0


def test_links_across_groups_that_fill_the_lists(spark):
    rng = np.random.default_rng(11)
    one, other = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    other = 0.93 * one + np.sqrt(1 - 0.93 ** 2) * other
    vectors = [c + 0.008 * rng.normal(size=64) for c in (one, other) for _ in range(40)]
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    sims = unit @ unit.T
    assert sims[:40, :40].min() > 0.98 and sims[:40, 40:].min() > 0.9 and sims[:40, 40:].max() < sims[:40, :40].min()
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in near_vectors(df).collect()} == {(79, 0)}


def test_audit_sees_small_groups_beside_a_hot_one(spark):
    rng = np.random.default_rng(14)
    hot = rng.normal(size=32) + 0.01 * rng.normal(size=(900, 32))
    pairs = np.repeat(rng.normal(size=(40, 32)), 2, axis=0) + 0.01 * rng.normal(size=(80, 32))
    units = np.concatenate([hot, pairs])
    units /= np.linalg.norm(units, axis=1)[:, None]
    df = spark.createDataFrame([(i, 32, bytearray(u.astype("<f8").tobytes())) for i, u in enumerate(units)], "cid long, dim int, unit binary")
    hot_only = spark.createDataFrame([(i, 0) for i in range(900)], "node long, root long")
    assert audit_recall(df, hot_only, 0.9) < 0.1
    whole = hot_only.unionByName(spark.createDataFrame([(i, i - i % 2) for i in range(900, 980)], "node long, root long"))
    assert audit_recall(df, whole, 0.9) == 1.0
    rooted = df.join(hot_only.withColumnRenamed("node", "cid"), "cid", "left").selectExpr("cid", "coalesce(root, cid) AS root", "unit")
    found = {(min(r), max(r)) for r in all_links(rooted, 980, 0.9).collect()}
    assert found == {(i, i + 1) for i in range(900, 980, 2)}


# ---------------------------------------------------------------- 9 SimHash
def plain_simhash(text, k=3):
    parts = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").split() if text else []
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + k]) for i in range(max(1, len(parts) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_anchors_meet_every_pair():
    rng = np.random.default_rng(0)
    for width, reach, t in ((32, 2, 1), (16, 3, 2)):
        code = Anchors(width, reach)
        for _ in range(200):
            x = int(rng.integers(0, 1 << width))
            y = x
            for b in rng.choice(width, t, replace=False):
                y ^= 1 << int(b)
            home = code.home(np.array([x], np.uint32))[0][0]
            assert home == code.home(np.array([y], np.uint32))[0][0] or home in code.visits(np.array([y], np.uint32))[1]


@pytest.mark.parametrize("threshold", [3, 8])
def test_simhash_groups(documents, threshold):
    rng = random.Random(10)
    base = [words(rng, 60) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(100, 260):  # a dense group of near copies, more than a block of its anchors
        parts = base[i % 3].split()
        parts[rng.randrange(len(parts))] = f"edit{rng.randrange(50)}"
        rows.append((i, " ".join(parts)))
    rows += [(1000 + (i or 0), t) for i, t in EDGES[:6]] + [(None, base[4]), (None, "nobody knows this one")]
    fps = [plain_simhash(t) for _, t in rows]
    assert fps == [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                parent[root(a)] = root(b)
    smallest = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root(n)] = min(i, smallest.get(root(n), i))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_groups(documents(rows), threshold=threshold).collect())
    assert got == Counter((i, fps[n], smallest.get(root(n))) for n, (i, _) in enumerate(rows))
    assert simhash_groups(documents(rows).where("false")).count() == 0


def shingle_set(text, k=5):
    parts = text.split()
    return {" ".join(parts[i:i + k]) for i in range(max(1, len(parts) - k + 1))}


def near_truth(texts):
    """Components of all pairs of 0.8, and the pairs; texts of fewer words are one shingle."""
    sets = [shingle_set(t.lower()) if t.split() else set() for t in texts]
    parent = list(range(len(texts)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    pairs = []
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                pairs.append((b, a))
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return pairs, [root(n) for n in range(len(texts))]


def edited(rng, parts, scattered):
    """A copy with one contiguous edit or several single ones that stays near 0.8 to 0.95."""
    parts = list(parts)
    if scattered:
        for at in rng.sample(range(len(parts)), rng.randint(1, max(1, len(parts) // 50))):
            parts[at] = f"edit{rng.randrange(10**6)}"
    else:
        n = rng.randint(1, max(1, len(parts) // 13))
        at = rng.randrange(len(parts) - n)
        parts[at:at + n] = [f"other{rng.randrange(10**6)}" for _ in range(n)]
    return parts


@pytest.mark.parametrize("scattered", [False, True])
def test_recall_of_near_copies(documents, scattered):
    """Pairs of an edited copy, from 0.8 up: at least nine of ten are found, and nothing below 0.8."""
    rng = random.Random(15 + scattered)
    texts = []
    for _ in range(150):
        parts = words(rng, rng.choice([60, 200, 700]), pool=90_000).split()
        texts += [" ".join(parts), " ".join(edited(rng, parts, scattered))]
    pairs, _ = near_truth(texts)
    groups = {r["doc_id"]: r["component_id"] for r in near_text_groups(documents(list(enumerate(texts)))).collect()}
    found = sum(groups[a] == groups[b] for a, b in pairs)
    print(f"recall, scattered={scattered}: {found} of {len(pairs)}")
    assert len(pairs) > 80 and found >= 0.95 * len(pairs)
    assert {frozenset(p) for p in ((i, groups[i]) for i in groups) if len(set(p)) == 2} <= {frozenset(p) for p in pairs}


def test_families_of_variants(documents):
    """Members of a family are linked over others; texts with a passage in common, or with repeated lines, stay apart."""
    rng = random.Random(16)
    texts = []
    for _ in range(6):
        family = [words(rng, 200, pool=90_000).split()]
        for _ in range(99):
            parts = list(rng.choice(family))
            for at in rng.sample(range(200), rng.randint(3, 6)):
                parts[at] = f"edit{rng.randrange(10**6)}"
            family.append(parts)
        texts += map(" ".join, family)
    shared = words(rng, 100, pool=90_000)
    texts += [shared + " " + words(rng, 60, pool=90_000) for _ in range(30)]
    texts += [" ".join([words(random.Random(1), 15)] * 200 + [words(rng, 100, pool=90_000)]) for _ in range(6)]
    texts += ["One two", "one  TWO", "", "   ", "one two three four five six", "one two three four five seven"]
    pairs, want = near_truth(texts)
    groups = {r["doc_id"]: r["component_id"] for r in near_text_groups(documents(list(enumerate(texts)))).collect()}
    assert all(want[n] == want[groups[n]] for n in groups)
    assert sum(groups[n] == want[n] for n in groups) >= 0.98 * len(texts)
    assert groups[600] == 600 and groups[len(texts) - 5] == len(texts) - 6 and groups[len(texts) - 3] == len(texts) - 4


def test_alike_in_bits_but_not_near_is_not_joined_with_all(documents, monkeypatch):
    """Texts that share three quarters of their words are candidates by their bits; what is left of them to be confirmed is no square."""
    rng = random.Random(17)
    shared = words(rng, 120, pool=90_000)
    texts = [shared + " " + words(rng, 25, pool=90_000) for _ in range(200)]
    texts += [texts[0] + " end", texts[1] + " end"]
    asked = []
    real = neartexts._confirmed
    monkeypatch.setattr(neartexts, "_confirmed", lambda pairs, sets, similarity: asked.append(pairs.count()) or real(pairs, sets, similarity))
    groups = {r["doc_id"]: r["component_id"] for r in near_text_groups(documents(list(enumerate(texts)))).collect()}
    assert groups == {**{n: n for n in range(200)}, 200: 0, 201: 1}
    assert asked[1] <= len(texts)


def test_pairs_to_confirm_follow_the_texts_not_their_pairs(documents, monkeypatch):
    """A family of near copies, and texts alike in their bits only, at anchors of many blocks: a pair or so for each text is confirmed."""
    rng = random.Random(21)
    monkeypatch.setattr(neartexts, "BLOCK", 16)
    shared, parts = words(rng, 120, pool=90_000), words(rng, 200, pool=90_000).split()
    texts = [shared + " " + words(rng, 25, pool=90_000) for _ in range(150)]
    for _ in range(150):
        places = rng.sample(range(200), 2)
        texts.append(" ".join(f"edit{rng.randrange(10**6)}" if at in places else w for at, w in enumerate(parts)))
    asked = []
    real = neartexts._confirmed
    monkeypatch.setattr(neartexts, "_confirmed", lambda pairs, sets, similarity: asked.append(pairs.count()) or real(pairs, sets, similarity))
    groups = {r["doc_id"]: r["component_id"] for r in near_text_groups(documents(list(enumerate(texts)))).collect()}
    assert groups == {n: min(n, 150) for n in range(300)}
    assert sum(asked) <= 3 * len(texts), asked


def test_sketches_leave_out_no_near_copies():
    rng = np.random.default_rng(18)
    for n in (0, 1, 5, 40, 400, 4000):
        for similarity in (0.5, 0.8):
            for cut in range(0, n // 2 + 1, max(1, n // 20)):
                both = rng.integers(0, 1 << 63, n - cut, np.uint64)
                x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, k, np.uint64)])) for k in (cut, cut // 2))
                alike = len(np.intersect1d(x, y)) >= similarity * len(np.union1d(x, y))
                rows = [np.frombuffer(neartexts.sketch(s), np.uint64)[None, :] for s in (x, y)]
                assert not alike or neartexts._may_be_near(*rows, similarity)[0]


def test_near_copies_of_edges(documents):
    rows = [(i, t) for i, t in EDGES] + [(8, "ünï " * 30), (None, "no id HERE")]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_text_groups(documents(rows)).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, None), (None, 1), (6, 6), (7, 7), (8, 7), (None, None)])
    assert near_text_groups(documents(rows).where("false")).count() == 0



# ---------------------------------------------------------------- 10 urls
def test_trust_goes_as_far_as_links_do(spark):
    """A chain of hosts into a blocked one, a cycle and a star, against power iteration by hand."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">l</a>' for h in hosts)
    chain = [f"c{i}.org" for i in range(16)]
    pages = [(i, f"https://{h}/x", link(chain[i + 1] if i < 15 else "bad.net")) for i, h in enumerate(chain)]
    pages += [(50, "https://bad.net/fr/", ""), (51, "https://r0.org", link("r1.org")), (52, "https://r1.org", link("r2.org", "bad.net")), (53, "https://r2.org", link("r0.org"))]
    pages += [(60 + i, f"https://s{i}.org", link("hub.org")) for i in range(5)] + [(70, "https://hub.org", link("bad.net", "good.com", "good.com"))] + [(71, "https://good.com/", link("hub.org"))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    hosts = {p[1].split("//")[1].split("/")[0] for p in pages}
    links = Counter((p[1].split("//")[1].split("/")[0], h) for p in pages for h in re.findall(r"https://([^/]+)/p", p[2]))
    for damping, limit in ((0.99, 0.1), (0.85, 0.25)):
        def spread(edges, seeds):
            out = Counter()
            for (a, _), n in edges.items():
                out[a] += n
            mass = dict(seeds)
            for _ in range(3000):
                moved = Counter(seeds)
                for (a, b), n in edges.items():
                    moved[b] += damping * mass.get(a, 0) * n / out[a]
                mass = moved
            return mass
        trust = spread(links, {"good.com": 1.0})
        distrust = spread(Counter({(b, a): n for (a, b), n in links.items()}), {"bad.net": 1.0})
        want = {h: "block" if distrust.get(h, 0) - trust.get(h, 0) >= limit else "allow" for h in hosts}
        got = {r["host"]: r["verdict"] for r in judge_urls(frame, damping=damping, limit=limit).where("rule IS NULL").collect()}
        assert got == {h: v for h, v in want.items() if h in got} and len(got) > 20
    assert {h for h, v in want.items() if v == "block"} > {"c15.org", "c14.org"}
    assert {r["verdict"] for r in judge_urls(frame, damping=0.99, limit=0.1).where("host LIKE 'c%.org'").collect()} == {"block"}
    assert judge_urls(frame.where("false")).count() == 0


def test_url_rules_and_link_trust(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">l</a>' for h in hosts)
    pages = [
        (1, "https://www.Example.com/en/x?q#f", link("good.org")), (2, "http://a.example.com/en/", ""), (3, "http://b.net/fr/1", ""), (4, "http://b.net/de/1", ""),
        (5, "ftp://farm.org/x", link("b.net", "b.net")), (6, "https://good.org", None), (7, None, "<a href=//b.net>"), (8, "no scheme", ""), (9, "https://example.com", ""), (9, "https://example.com", ""),
        (10, "https://notexample.com/en/", ""), (None, "x://Y.es/fr/", link("b.net")),
    ]
    got = judge_urls(spark.createDataFrame([(*p, "other") for p in pages], "page_id long, url string, html string, host string")).collect()
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(pages)
    assert rows[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and rows[2][2:] == ("example.com/en/", "block")
    assert rows[3][2:] == ("net/fr/", "block") and rows[4] == ("b.net", "/de/1", None, "block")
    assert rows[5] == ("farm.org", "/x", None, "block") and rows[6] == ("good.org", "", None, "allow")
    assert rows[7] == ("", "", None, "allow") and rows[8][:2] == ("", "") and rows[9] == ("example.com", "", None, "allow")
    assert rows[10][2:] == ("com/", "allow") and rows[None][:2] == ("y.es", "/fr/")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_workers_let_other_operators_memos_go():
    gone = []
    common.keep_between_tasks("braidset.llm.packing", lambda: gone.append("packing"))

    def work(batches):
        yield from batches

    work.__module__ = "braidset.llm.packing"
    assert list(common.tidied(work)(iter([1]))) == [1] and gone == []
    work.__module__ = "braidset.llm.langid"
    assert list(common.tidied(work)(iter([1, 2]))) == [1, 2] and gone == ["packing"]
    assert list(common.tidied(work)(iter([]))) == [] and gone == ["packing"]
