"""The ten operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, class_lm, common, cover_tree, near_dup, packing, quality_knn, quality_rules, suffix_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, bucket string, keys string, home string"


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [(i, text(r.randint(1, 120))) for i in range(60)]
    base, passage = text(150), text(40)
    for i in range(60, 90):
        w = base.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w)))
    out += [(90 + i, f"{text(10)} {passage} {text(10)}\nend. <|endoftext|>") for i in range(8)]
    out += [(98, None), (99, ""), (100, "  \n\t"), (101, "a b"), (102, "a b"), (103, "A B C"), (104, "a b c"), (105, text(9000)), (106, "x" * 400), (107, "xx " * 300), (None, base), (5, out[5][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # more columns, with the names that the operators use inside
    return spark.createDataFrame([(i, t, "b", "k", "h") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(rows, width):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    return sets


def brute_components(rows, width, percent):
    """(set size, least doc_id of the group) of each row."""
    sets, parent = shingle_sets(rows, width), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    return [(len(sets[i]), None if a is None else least[root(i)]) for i, (a, _) in enumerate(rows)]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, none, width, percent):
    want = sorted((str(a), *x) for (a, _), x in zip(rows, brute_components(rows, width, percent)))
    got = near_dup.near_duplicates(docs, width, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id is not None)
    assert near_dup.near_duplicates(none, width, percent).count() == 0
    out = near_dup.keep_first(docs, width, percent)
    assert out.schema == docs.schema and out.where("home = 'h' and keys = 'k'").count() == sum(a is None or a == c for (a, _), (_, c) in zip(rows, brute_components(rows, width, percent)))


def chained(n_groups, size, seed):
    """Texts of groups around the threshold: sub-clusters that drift apart step
    by step, their members with changes of their own."""
    r, out = random.Random(seed), []
    fresh = lambda: f"w{r.randrange(10**9)}"
    for _ in range(n_groups):
        base = [fresh() for _ in range(120)]
        for k in range(size):
            if k % 6 == 0:
                base[r.randrange(120)] = fresh()
            w = list(base)
            for _ in range(r.randint(1, 5)):
                w[r.randrange(120)] = fresh()
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n_groups,size,block", [(1, 2400, 1024), (2, 300, 64)])
def test_near_duplicates_around_the_threshold(spark, monkeypatch, n_groups, size, block):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block, raising=False)
    texts = chained(n_groups, size, 11)
    sets = shingle_sets(list(enumerate(texts)), 3)
    ids = {x: i for i, x in enumerate(set().union(*sets))}
    wide = np.zeros((len(texts), len(ids)), np.float32)
    for i, x in enumerate(sets):
        wide[i, [ids[y] for y in x]] = 1
    n, common = wide.sum(1), wide @ wide.T
    like = 100 * common >= 85 * (n[:, None] + n - common)
    want = np.arange(len(texts))
    while True:
        now = np.where(like, want, len(texts)).min(1)
        if (now == want).all():
            break
        want = now
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    assert 1 < len(set(want.tolist())) < len(texts)
    assert [got[i] for i in range(len(texts))] == want.tolist()


def test_a_link_between_two_that_were_no_hubs(spark):
    """x1 - x2 - y2 - y1 is a chain; x1, y1 and others weigh more in each bucket that x2 and y2 share."""
    r, texts = random.Random(4), {}
    w = [f"w{i}" for i in range(200)]
    for k, name in enumerate(("x1", "x2", "y2", "y1")):
        for i in range(3 * (k > 0)):
            w[10 + 60 * i + 10 * k] = f"{name}-{i}"
        texts[name] = " ".join(w)
    texts |= {f"d{i}": " ".join(f"d{i}-{j}" for j in range(200)) for i in range(3)}
    sizes, d, h = near_dup.sets_of([x.encode() for x in texts.values()], 3, common.WordHashes())
    digests = near_dup.digests(sizes, h)
    nodes = {x: 1000 + i for i, x in enumerate(texts)}
    rows = []
    for i, name in enumerate(texts):
        bands = [1, 3 + i if name in ("x2", "y2") else 2, *(r.randrange(10**6, 2**62) for _ in range(30))]
        rows.append((nodes[name], digests[i], np.array(bands, "<u8").tobytes(), int(sizes[i]), i))
    classes = spark.createDataFrame(rows, "node long, digest binary, bands binary, n_shingles long, doc_id long")
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {x.node: x.component for x in near_dup._linked(classes, docs, "doc_id", "text", 3, 85).collect()}
    assert set(got) == {nodes[x] for x in ("x1", "x2", "y1", "y2")} and len(set(got.values())) == 1


def brute_removed(rows):
    """Which bytes of each text go."""
    first, order = {}, sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        x = (rows[i][1] or "").encode()
        for s in range(len(x) - 49):
            first.setdefault(x[s : s + 50], rows[i][0])
    out = []
    for a, t in rows:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - 49):
            f = first[x[s : s + 50]]
            if f is not None and (a is None or f < a):
                gone[s : s + 50] = True
        out.append(gone)
    return out


def brute_kept_text(text, gone):
    """A character of which a byte goes, goes whole."""
    kept, at = "", 0
    for c in text:
        n = len(c.encode())
        kept += c * (not gone[at : at + n].any())
        at += n
    return kept


def test_suffix_dedup(docs, rows, none):
    want = []
    for (a, t), gone in zip(rows, brute_removed(rows)):
        x = (t or "").encode()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
        want.append((str(a), len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    got = suffix_dedup.repeat_spans(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup.repeat_spans(none).count() == 0
    out = suffix_dedup.remove_repeats(docs)
    assert out.schema == docs.schema and out.where("home = 'h' and bucket = 'b' and keys = 'k'").count() == len(rows)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_cut_characters_go_whole(spark):
    passage = "abcdefghij" * 6
    texts = [(1, "丠" + passage + "P奀"), (2, "aaa你" + passage + "P好zzz"), (3, None), (4, ""), (5, "é" * 80), (6, "x" + "é" * 80 + "è")]
    docs = spark.createDataFrame([(i, t, "h", i) for i, t in texts], "doc_id long, text string, home string, n_chars long")
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()}
    want = {i: None if t is None else brute_kept_text(t, gone) for (i, t), gone in zip(texts, brute_removed(texts))}
    assert got == want and got[2] == "aaazzz"
    assert suffix_dedup.without(b"\x80ab", np.array([False, True, False])) == b"\x80b"


def brute_repeats(w, least):
    """For each word the longest repeat of ``least`` words or more that starts there."""
    out = [0] * len(w)
    at = {}
    for i in range(len(w) - least + 1):
        at.setdefault(tuple(w[i : i + least]), []).append(i)
    for places in at.values():
        for i in places:
            for j in places:
                if i != j:
                    k = least
                    while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                        k += 1
                    out[i] = max(out[i], k)
    return out


def brute_quality(text):
    """(words, repeated words, covered words, longest repeat, base failed, kept)."""
    w = WORD.findall(text or "")
    long = brute_repeats(w, 5)
    cover = {i + k for i, n in enumerate(long) if n for k in range(n)}
    wide = {i + k for i, n in enumerate(long) if n >= 8 for k in range(n)}
    failed = len(w) < 20 or 100 * len(wide) > 30 * len(w)
    kept = not failed and 100 * len(cover) <= quality_rules.MAX_COVERED * len(w) and max(long, default=0) <= quality_rules.MAX_LONGEST
    return len(w), len(wide), len(cover), max(long, default=0), failed, kept


def test_quality_rules(docs, rows, none):
    got = {(str(r.doc_id), r.word_chars): r for r in quality_rules.repetition(docs).collect()}
    for a, t in rows:
        t = t or ""
        r = got[str(a), sum(map(len, WORD.findall(t)))]
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert (r.n_words, r.n_repeat_words, r.n_covered, r.longest_repeat, r.base_failed, r.kept) == brute_quality(t)
    assert quality_rules.repetition(none).count() == 0
    assert quality_rules.keep_good(docs).schema == docs.schema
    assert quality_rules.keep_good(docs).count() == sum(brute_quality(t)[-1] for _, t in rows)


ODD = ["Don't I'll SHE'D", "<|endoftext|>x <|startoftext|>", "İstanbul ΣΑΣ ß", "a\x1cb \x00 \x7f\x85", "１２３ ½ 你好 😀😀", "é" * 300, "'S 'T 'LL", "ſ K Å", "́abc"]


def test_bpe_is_the_librarys(spark, docs, rows, none):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    texts = [(i, x) for i, (_, x) in enumerate(rows)] + [(1000 + i, x) for i, x in enumerate(ODD)]
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(texts, "doc_id long, text string"), full=True).collect()}
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(none).count() == 0
    r = random.Random(3)
    enc = bpe.encoder()
    words = sorted({"".join(r.choice("aeinrst'") for _ in range(r.randint(1, 14))).strip("'") or "a" for _ in range(3000)})
    words = [w for w in words if "'" not in w]
    assert [ids for _, ids in enc.encode_sorted(words)] == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_bpe_words_around_the_short_limit():
    """Long words that share prefixes of all sizes, alone and side by side with special tokens and odd white space."""
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    r = random.Random(7)
    stem = "".join(r.choice("aeionrstlé") for _ in range(400))
    words = [stem[:n] + tail for n in (1, 2, bpe.SHORT - 2, bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 90, 200, 400) for tail in ("", "x", "ing", "***", "é9é")]
    texts = ["", "  ", *words, " ".join(words), "\x0b" + "\n\n".join(reversed(words)) + "\x1f ", "<|endoftext|>".join(words[:9]), "a<|b " + words[-1]]
    enc = bpe.WordPieces()
    got = enc.encode_many([x.encode() for x in texts])
    assert [np.frombuffer(p, "<u4").tolist() for p in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert enc.encode_many([]) == []


def check_packed(got, rows):
    """Every piece of the rows is there, in sequences without gaps."""
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for _, x in rows]
    want = sorted((str(a), s // 2048, s, len(p := i[s : s + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for (a, _), i in zip(rows, ids) for s in range(0, len(i), 2048))
    assert sorted((str(None if math.isnan(a) else int(a)), b, c, d, e) for a, b, c, d, e in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_packing(docs, rows, none):
    check_packed(packing.pack(docs).toPandas(), rows)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("low,high,n,share", [(1, 2048, 20_000, 1.01), (300, 2047, 50_000, 1.03), (1, 200, 5_000, 1.001), (2048, 2048, 7, 1.0), (1500, 1500, 9, 2.0), (900, 1024, 3_000, 1.08), (5, 5, 1, 1.0)])
def test_plan_holds_everything(low, high, n, share):
    r = random.Random(5)
    counts = dict(Counter(r.randint(low, high) for _ in range(n)))
    runs = packing.plan(counts)
    held = Counter()
    for times, lengths in runs:
        assert sum(lengths) <= 2048 and times > 0
        for x in lengths:
            held[x] += times
    assert dict(held) == counts
    assert sum(t for t, _ in runs) <= share * -(-sum(k * v for k, v in counts.items()) // 2048)
    assert packing.plan({}) == []


def test_groups_are_even_and_configurations_cover():
    r = random.Random(9)
    counts = dict(Counter(min(2047, int(r.expovariate(1 / 600)) + 257) for _ in range(30_000)))
    groups = packing.grouped(counts, 32)
    share = -(-30_000 // 32)
    assert len(groups) <= 32 and all(sum(c for _, c in g) == share for g in groups[:-1])
    assert [n for g in groups for n, _ in g] == sorted((n for g in groups for n, _ in g), reverse=True)
    sizes, demand = [9, 7, 4, 3], [40, 31, 50, 77]
    found = packing.configurations(sizes, demand, 20)
    used = Counter()
    for times, config in found:
        assert sum(sizes[j] * k for j, k in config) <= 20
        used.update({j: times * k for j, k in config})
    assert all(used[j] <= d for j, d in enumerate(demand))
    # one sequence a size at most is left to round off
    assert sum(t for t, _ in found) >= sum(s * d for s, d in zip(sizes, demand)) / 20 - len(sizes)
    price, column = packing.best_column(sizes, np.array([0.5, 0.36, 0.21, 0.14]), 20)
    brute = max((a * 0.5 + b * 0.36 + c * 0.21 + d * 0.14, a, b, c, d) for a in range(3) for b in range(3) for c in range(6) for d in range(7) if 9 * a + 7 * b + 4 * c + 3 * d <= 20)
    assert abs(price - brute[0]) < 1e-9 and sum(c * s for c, s in zip(column, sizes)) <= 20


def test_class_lm(docs, rows, none, monkeypatch):
    monkeypatch.setattr(class_lm, "HOT", 40)
    held = common.crc_of(F.col("doc_id")) % 5 == 1
    got = class_lm.score(docs, held, docs.where(~held)).collect()
    count, is_held = Counter(), lambda a: a is not None and zlib.crc32(str(a).encode()) % 5 == 1
    for a, x in rows:
        if not is_held(a):
            count.update([*lower(x).encode().split(), b"\n"])
    n, v, want = sum(count.values()), len(count), []
    for a, x in rows:
        w = [*lower(x).encode().split(), b"\n"]
        want.append((str(a), is_held(a), len(w), sum(count[y] > 0 for y in w), n, round(sum(math.log10((count[y] + 0.5) / (n + 0.5 * (v + 1))) for y in w), 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert class_lm.score(none, held, none.where(~held)).count() == 0


def test_exchange_ends_where_no_move_helps():
    r = np.random.default_rng(3)
    n = r.poisson(r.random((30, 30)) * 6 * (r.random((30, 30)) < 0.4))
    f = lambda x: float((x * np.log(np.maximum(x, 1.0))).sum())

    def likelihood(cls):
        one = np.zeros((30, 5))
        one[np.arange(30), cls] = 1
        cc = one.T @ n @ one
        return f(cc) - f(cc.sum(0)) - f(cc.sum(1))

    cls = class_lm.exchange(n, 5, 100)
    best = likelihood(cls)
    assert cls[0] == 0 and (cls[1:] > 0).all()
    for i in range(1, 30):
        for k in range(1, 5):
            other = cls.copy()
            other[i] = k
            assert likelihood(other) <= best + 1e-6
    start = np.concatenate([[0], 1 + np.arange(29) % 4])
    assert best > likelihood(start)


def test_class_lm_is_the_plain_model(spark):
    """Every probability, and the moves of the words outside the top, by Python."""
    r = random.Random(12)
    words = [f"{r.choice('abcdefgh')}{i:x}{r.choice(['', ',', '.'])}" for i in range(2600)]
    texts = [(i, " ".join(words[int(2600 * r.random() ** 2)] for _ in range(r.randint(0, 160)))) for i in range(400)] + [(400, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    held = F.col("doc_id") % 7 == 3
    lines = {i: [*lower(t).encode().split(), b"\n"] for i, t in texts}
    train = [w for i, w in lines.items() if i % 7 != 3]
    own = docs.where(~held).select("text")
    counts = class_lm.written(class_lm.word_counts(own, "text", 5), "words")
    count = Counter(chain.from_iterable(train))
    total = sum(count.values())
    model, distinct = class_lm.learn(own, "text", counts, total, 5)
    assert distinct == len(count) > class_lm.TOP + 500
    cls_of = lambda w: int(model.known.value_of(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64), np.array([class_lm.shape_of(w)]))[0])
    cls = {w: cls_of(w) for w in {*chain.from_iterable(lines.values())}}
    assert cls[b"\n"] == 0 and all(c > 0 for w, c in cls.items() if w != b"\n")
    c = class_lm.CLASSES
    cc, tokens, kinds = np.zeros((c, c)), np.zeros(c), np.zeros(c)
    for line in train:
        for x, y in zip([b"\n", *line], line):
            cc[cls[x], cls[y]] += 1
    for w, k in count.items():
        tokens[cls[w]] += k
        kinds[cls[w]] += 1
    into = (cc.sum(0) + 0.5) / (cc.sum() + 0.5 * c)
    step = (cc + class_lm.BACK_OFF * into) / (cc.sum(1, keepdims=True) + class_lm.BACK_OFF)
    assert np.allclose(step.sum(1), 1)
    want = {i: sum(math.log10(step[cls[x], cls[y]] * (count[y] + 0.5) / (tokens[cls[y]] + 0.5 * (kinds[cls[y]] + 1))) for x, y in zip([b"\n", *line], line)) for i, line in lines.items()}
    got = {row.doc_id: row.score for row in class_lm.score(docs, held, docs.where(~held)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)
    # moves
    hashed = lambda ws: np.array([xxhash.xxh3_64_intdigest(w) for w in ws], np.uint64)
    top = [w for w, _ in count.most_common(200) if w != b"\n"]
    classes, shapes = np.array([0, *(1 + i % (c - 1) for i in range(len(top)))]), 1 + np.arange(class_lm.SHAPES) % (c - 1)
    so_far = class_lm.Known(hashed([b"\n", *top]), classes, shapes)
    value = {w: int(so_far.value_of(hashed([w]), np.array([class_lm.shape_of(w)]))[0]) for w in count}
    gains = class_lm.move_gains(np.random.default_rng(1).integers(0, 50, (c, c)).astype(float))
    send = spark.sparkContext.broadcast
    h, k = class_lm.own_classes(own, "text", send(so_far), send(class_lm.Known(hashed(count), np.zeros(len(count), np.int8), shapes)), send(gains), 5)
    moved = dict(zip(h.tolist(), k.tolist()))
    rest = [w for w in count if w not in {b"\n", *top}]
    near = {w: np.zeros(2 * c) for w in rest}
    for line in train:
        for x, y, z in zip([b"\n", *line], line, line[1:]):
            if y in near:
                near[y][value[x]] += 1
                near[y][c + value[z]] += 1
    assert moved.keys() == set(hashed(rest).tolist())
    for w in rest:
        gain = near[w] @ gains
        assert gain[moved[int(hashed([w])[0])]] >= gain.max() - 1e-9


def test_class_lm_has_no_word_beyond_its_cap(spark, monkeypatch):
    """How many words every task holds changes no class and no score."""
    r = random.Random(5)
    words = [f"{r.choice('abcdefgh')}{i:x}{r.choice(['', ',', '.'])}" for i in range(2400)]
    docs = spark.createDataFrame([(i, " ".join(words[int(2400 * r.random() ** 2)] for _ in range(r.randint(0, 120)))) for i in range(300)] + [(300, "unseen here"), (301, None)], "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 6 == 0
    got = []
    for hot in (2_000_000, 3000, 60):
        monkeypatch.setattr(class_lm, "HOT", hot)
        got.append({x.doc_id: tuple(x)[1:] for x in class_lm.score(docs, held, docs.where(~held)).collect()})
    for other in got[1:]:
        assert got[0].keys() == other.keys()
        assert all(got[0][i][:4] == other[i][:4] and all(abs(a - b) < 1e-6 for a, b in zip(got[0][i][4:], other[i][4:])) for i in got[0])


def brute_top_k(rows, is_query, k=5):
    """(query_id, rank, vec_id, score) by Python's integers."""
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, most = [], 2**63 - 1
    for i in sorted({i for i, _ in good if is_query(i)}):
        scores = []
        for q in {tuple(v) for j, v in good if j == i}:
            scores += [(-max(-most, min(most, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i and len(v) == len(q)]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def clustered(n, seed, width=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width)) * 4
    return (centres[r.integers(0, 12, n)] + r.normal(size=(n, width)) * 0.2).astype("float32")


def test_top_k(spark, monkeypatch):
    v = np.random.default_rng(2).normal(size=(600, 16)).astype("float32")
    v[100:140] = v[50]
    inf = float("inf")
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [float("nan")] * 16), (702, [None] * 16), (703, [inf] * 16), (704, []), (750, [1.0, 2.0]), (None, v[0].tolist())]
    of = lambda rows: spark.createDataFrame([(*x, "z", 1) for x in rows], "vec_id long, embedding array<float>, block string, cell int")
    got = lambda table: sorted(tuple(x) for x in cover_tree.top_k(table, F.col("vec_id") % 50 == 0).collect())
    assert got(of(rows)) == brute_top_k(rows, lambda i: i % 50 == 0)
    assert got(of(rows).where("vec_id < 0")) == []
    # many cells, blocks, groups and lanes
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 90)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 3)
    monkeypatch.setattr(cover_tree, "LANE", 2)
    rows = [(i, x.tolist()) for i, x in enumerate(clustered(1500, 5))] + [(i, [1.0, float(i % 3)]) for i in range(2000, 2300)]
    assert got(of(rows)) == brute_top_k(rows, lambda i: i % 50 == 0)


def test_top_k_of_repeated_rows_and_large_components(spark):
    one = lambda *rows: (list(rows), sorted(tuple(x) for x in cover_tree.top_k(spark.createDataFrame(list(rows), "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()))
    same = [1.0, 0.0]
    for rows, got in (
        one(*[(50, same)] * 7, (51, same), (52, [2.0**41, 0.0]), (53, [0.5, 0.0])),
        one(*((i, same) for i in (1, 2, 3, 4, 50, 50, 60, 61))),
        one((50, [1e30, -3.0]), (1, [1e30, 5.5]), (2, [-1e30, 5.5]), (3, [0.0, 7.0]), (4, [2.0**50, 2.0**50]), (5, [2.0**52, 1.0])),
        one((100, [2.0**45, 1.0]), (1, [2.0**-8, 3.0]), (2, [2.0**-8, 4.0]), (150, [0.0, 0.0])),
    ):
        assert got == brute_top_k(list(dict.fromkeys((i, tuple(v)) for i, v in rows if i % 50 == 0)) + [r for r in rows if r[0] % 50], lambda i: i % 50 == 0)


def test_cover_tree_is_one():
    """Nesting, covering, separation, and that near clusters prune far ones."""
    x = np.unique(np.floor(256 * clustered(3000, 9).astype(float)), axis=0)
    root = cover_tree.tree(x)
    nodes, todo = 0, [root]
    while todo:
        at = todo.pop()
        nodes += 1
        assert np.sqrt(((x[at.rows] - at.centre) ** 2).sum(1)).max() <= at.radius * (1 + 1e-9) + 1e-6
        if at.children:
            centres = np.array([c.centre for c in at.children])
            assert (centres == at.centre).all(1).any()
            assert sorted(np.concatenate([c.rows for c in at.children]).tolist()) == sorted(at.rows.tolist())
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e18
            assert apart.min() > max(c.radius for c in at.children) * (1 - 1e-9)
        todo.extend(at.children)
    block = cover_tree.Block(x, np.arange(len(x)), 5)
    q = x[::50]
    best = cover_tree.dual_search(q, np.arange(0, len(x), 50), block, 5)
    assert nodes > 30 and best.compared < 0.5 * len(q) * len(x)


#: The contract's rules, stated apart from the module's.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_url_filter(spark):
    long = "http://" + "a." * 300 + "net/de/" + "x" * 50_000
    urls = ["http://A.example.com/en/71", "http://a.example.com/en/81?x", "https://com/en/", "http://xcom/en/", "ftp://b.net/de/8#f", "http://example.net/de/8", "http://q.example.net/de/81", "http://example.net/de/7",
            "nothing", None, "", "://org/es/", "http://a.org", "http://org/ES/", "http://é.org/es/ü", "http://x://com/en/", long, long, "http://com"]
    table = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(table).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *max(fit, key=lambda r: len(r[0]), default=(None, "allow")))
    assert url_filter.judge_urls(table.union(table)).count() == 2 * len(urls)
    assert url_filter.judge_urls(table.where("page_id < 0")).count() == 0
    many = tuple(url_filter.Rule(f"h{i}.com", "/", "block") for i in range(300)) + (url_filter.Rule("h7.com", "/x", "allow"),)
    hosts = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/x")).alias("url"))
    assert sorted(r.page_id for r in url_filter.judge_urls(hosts, many).where("verdict = 'block'").collect()) == [i for i in range(300) if i != 7]


def test_later_levels_follow_the_rules_not_the_corpus(spark):
    keys = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    levels = url_filter.cascades(keys, {"block": ["k5", "k9", "none"]})["block"]
    assert sum(x.size for x in levels[1:]) <= 4 * url_filter.ROOM * 3 * len(levels) + 64 * len(levels)
    assert sorted(r.key for r in keys.where(url_filter.member(levels, F.col("key"))).collect()) == ["k5", "k9"]


def labelled(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(["plain", "word", "tree", "house", "water", "stone"]) + str(r.randint(0, 9)) * r.randint(0, 1) for _ in range(60)]
        bad, junk = i % 4 == 0, i % 5 == 0
        for _ in range(3 * bad):
            w[r.randrange(60)] = r.choice(["grumbleshank", "Grumbl3shank", "gRumblеshank", "snotwort"])
        t = " ".join(w)
        rows.append((i, t.upper() + "!! ##" * 40 if junk else t))
        labels.append((i, int(not junk), int(bad)))
    rows += [(900, None), (901, ""), (None, "tree house"), (902, "word " * 30000)]
    return spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, score string, y int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.learn(toxicity.labelled_sample(docs, labels, "toxic", toxicity.train_rows, 1000))
    got = toxicity.score_texts(docs, lexicon, toxicity.held_out(F.col("doc_id"))).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.toxic).mean() > 0.95
    assert toxicity.keep_clean(docs, lexicon).columns == docs.columns
    empty = toxicity.learn(toxicity.labelled_sample(docs, labels.limit(0), "toxic", toxicity.train_rows, 1000))
    assert toxicity.score_texts(docs, empty, toxicity.held_out(F.col("doc_id"))).agg(F.max("score")).first()[0] == 0


def plain_words(text):
    """Folded words, one character at a time."""
    out = "".join(toxicity.FOLD.get(ord(c), c) or "" for c in (text or "").lower())
    return out.split()


def plain_matched(words, weights, exceptions):
    total = 0.0
    for i, w in enumerate(words):
        hits = [x for t, x in weights.items() if (t[1:-1] == w if t[-1] == " " else w.startswith(t[1:]))]
        near = {f" {words[i - 1]} {w} "} if i else set()
        near |= {f" {w} {words[i + 1]} "} if i + 1 < len(words) else set()
        if hits and not exceptions.intersection(near):
            total += max(hits)
    return total


def plain_lexicon(rows):
    """Weights and exceptions of (text, y) rows."""
    n = Counter(y for _, y in rows)
    toxic, clean = Counter(), Counter()
    for t, y in rows:
        terms = set()
        for w in plain_words(t):
            if len(w) > 2:
                terms |= {f" {w} "} | {f" {w[:k]}" for k in (4, 5, 6) if len(w) > k}
        (toxic if y else clean).update(terms)
    weights = {}
    for t, k in toxic.items():
        weight = math.log((k + 0.5) / (n[1] + 1)) - math.log((clean[t] + 0.5) / (n[0] + 1))
        whole = [toxic[o] for o in toxic if o[-1] == " " and o.startswith(t)]
        if k >= toxicity.SUPPORT and weight >= toxicity.LEAST_WEIGHT and (t[-1] == " " or max(whole, default=0) < 0.8 * k):
            weights[t] = weight
    good, bad = Counter(), Counter()
    for t, y in rows:
        w, found = plain_words(t), set()
        for i, x in enumerate(w):
            if any(x == k[1:-1] if k[-1] == " " else x.startswith(k[1:]) for k in weights):
                found |= {f" {w[i - 1]} {x} "} if i else set()
                found |= {f" {x} {w[i + 1]} "} if i + 1 < len(w) else set()
        (bad if y else good).update(found)
    return weights, {p for p in good if good[p] >= toxicity.SUPPORT and bad[p] * n[0] <= 0.2 * good[p] * n[1]}


def toxic_table(spark):
    """Insults, also in disguise; a word that is harmless beside another one."""
    r, rows, labels = random.Random(8), [], []
    plain = ["tree", "house", "water", "stone", "river", "plain"]
    for i in range(500):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        bad = i % 3 == 0
        for _ in range(2 * bad):
            w.insert(r.randrange(len(w)), r.choice(["gromble", "Gr0mbles", "grоmble", "gromble,", "vexling"]))
        w += ["vexling"] * bad
        if i % 36 == 1:
            w.insert(r.randrange(len(w)), "pond vexling")
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "gromble"), (902, "a" * 100_000 + " gromble " + " " * 100_000 + "x"), (903, "ｇｒｏｍｂｌｅ!! vex-ling"), (5, rows[5][1])]
    return rows, labels, spark.createDataFrame([(*x, "s", "l") for x in rows], "doc_id long, text string, score string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_the_plain_one(spark):
    rows, labels, docs, marks = toxic_table(spark)
    lexicon = toxicity.learn(toxicity.labelled_sample(docs, marks, "toxic", toxicity.train_rows, 1000))
    text, train = dict(rows), lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    sample = [(text[i], y) for i, y in labels if train(i)]
    weights, exceptions = plain_lexicon(sample)
    assert lexicon.weights.keys() == weights.keys() and all(abs(lexicon.weights[t] - x) < 1e-12 for t, x in weights.items())
    assert set(lexicon.exceptions) == exceptions and " pond vexling " in exceptions
    x = np.array([[1.0, math.log1p(m := plain_matched(w := plain_words(t), weights, exceptions)), math.log1p(1000 * m / (len(w) + 20))] for t, _ in sample])
    p = 1 / (1 + np.exp(-x @ lexicon.curve))
    assert np.abs(x.T @ (p - [y for _, y in sample]) + 1e-2 * np.array(lexicon.curve)).max() < 1e-5  # the penalised likelihood's top
    want = []
    for i, t in rows:
        m = plain_matched(w := plain_words(t), weights, exceptions)
        score = 1 / (1 + math.exp(-np.dot([1.0, math.log1p(m), math.log1p(1000 * m / (len(w) + 20))], lexicon.curve)))
        want.append((str(i), i is not None and not train(i), round(score, 9), int(score >= 0.5)))
    got = toxicity.score_texts(docs, lexicon, toxicity.held_out(F.col("doc_id"))).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in got) == sorted(want)
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.schema == docs.schema and kept.count() == sum(x[-1] == 0 for x in want)
    assert toxicity.score_texts(docs.limit(0), lexicon, toxicity.held_out(F.col("doc_id"))).count() == 0


def test_exception_phrases():
    lexicon = toxicity.Lexicon({" scum ": 5.0}, frozenset({" pond scum "}), (0.0, 1.0, 1.0))
    a = lexicon.automaton()
    assert lexicon.matched("you sсum", a)[0] == 5 and lexicon.matched("green pond scum", a)[0] == 0 and lexicon.matched("5cum", a)[0] == 5


def test_quality_is_the_plain_one(spark):
    """Terms, latent space and votes by plain formulas."""
    docs, labels = labelled(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(7, None)]
    marks = {r.doc_id: r.quality for r in labels.collect()}
    docs = docs.union(spark.createDataFrame([(7, None, "s", 1)], docs.schema))  # an id twice: the row with a text counts
    space = quality_knn.fit(quality_knn.labelled_sample(docs, labels, "quality", quality_knn.train_rows, 1000))
    sample = [((t or "").encode(), marks[i]) for i, t in rows if i in marks and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    pairs_of = lambda x: Counter(zip(x, x[1:]))
    df = Counter(k for x, _ in sample for k in pairs_of(x))
    pairs = sorted(a * 256 + b for a, b in sorted(df, key=lambda k: (-df[k], k[0] * 256 + k[1]))[: quality_knn.PAIRS])
    pairs += [p for p in range(65536) if (p >> 8, p & 255) not in df][: quality_knn.PAIRS - len(pairs)]
    assert space.pairs.tolist() == sorted(pairs)

    def terms(x):
        c = pairs_of(x)
        return np.array([math.sqrt(c[p >> 8, p & 255] / len(x)) * (math.log((len(sample) + 1) / (df[p >> 8, p & 255] + 1)) + 0.25) for p in sorted(pairs)] + list(quality_knn.ratios(x)))

    x = np.array([terms(t) for t, _ in sample])
    mean = x.mean(0)
    basis = np.linalg.svd(x - mean, full_matrices=False)[2][: quality_knn.DIMS].T
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    known = [(unit((v - mean) @ basis), y) for v, (_, y) in zip(x, sample)]
    prior = sum(y for _, y in sample) / len(sample)
    got = quality_knn.score_texts(docs, space, quality_knn.held_out(F.col("doc_id"))).collect()
    texts = {(str(i), t): (t or "").encode() for i, t in rows}
    want = []
    for (i, _), t in texts.items():
        score = prior
        if t:
            v = unit((terms(t) - mean) @ basis)
            near = sorted(((float(v @ k), y) for k, y in known), reverse=True)[: quality_knn.NEIGHBOURS]
            w = [max(c, 0) ** 4 + 1e-9 for c, _ in near]
            score = sum(a * y for a, (_, y) in zip(w, near)) / sum(w)
        want.append((i, score))
    assert len(got) == len(want)
    close = [abs(a.score - b[1]) < 2e-3 for a, b in zip(sorted(got, key=lambda r: (str(r.doc_id), r.score)), sorted(want))]
    assert all(close)
    assert quality_knn.score_texts(docs.limit(0), space, quality_knn.held_out(F.col("doc_id"))).count() == 0


def test_quality_votes(spark):
    docs, labels = labelled(spark)
    space = quality_knn.fit(quality_knn.labelled_sample(docs, labels, "quality", quality_knn.train_rows, 1000))
    got = quality_knn.score_texts(docs, space, quality_knn.held_out(F.col("doc_id"))).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95
    empty = quality_knn.fit(quality_knn.labelled_sample(docs, labels.limit(0), "quality", quality_knn.train_rows, 1000))
    assert set(quality_knn.score_texts(docs, empty, quality_knn.held_out(F.col("doc_id"))).toPandas().score) == {0.5}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (30, 30)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert {got[i] for i in (3, 4, 5, 9)} == {3} and got[21] == 20 and {got[i] for i in range(100, 161)} == {100}


def test_tables_are_cleared(spark, tmp_path):
    import os

    made = common.written(spark.range(3), "gone")
    path = common._TABLES[spark.sparkContext.applicationId][-1]
    local = path.removeprefix("file:")
    assert made.count() == 3 and os.path.isdir(local)
    common.delete(spark, [path])
    assert not os.path.exists(local)


def corpus(spark, tmp_path):
    """Documents and labels for all stages, as files."""
    r = random.Random(21)
    words = ["".join(r.choice("aeiostnrlm") for _ in range(r.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, labels, passage = [], [], text(60)
    for i in range(260):
        w, bad = text(r.randint(10, 130)).split(), i % 4 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["grumbleshank", "Grumbl3shank", "gRumblеshank"]))
        if i % 9 == 1:
            w += passage.split() + ["naïve", "丠奀"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    near = text(100).split()
    for i in range(260, 290):
        w = list(near)
        for _ in range(i % 4):
            w[r.randrange(100)] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(290, None), (291, ""), (292, "same words " * 200), (293, text(6000)), (None, text(50)), (294, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return labels


def test_pipeline_is_the_plain_one(spark, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    import corpus_pipeline

    labels = corpus(spark, tmp_path)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in now.collect()]
        out = stage(spark, now, str(tmp_path))
        if name == "best_fit_packing":
            packed = out.toPandas()
            check_packed(packed, [r[:2] for r in rows])
            break
        out.write.parquet(f"{tmp_path}/{k}")
        assert out.schema == now.schema
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "quality_rules":
            want = [r for r in rows if brute_quality(r[1])[-1]]
        elif name == "toxicity":
            text = {r[0]: r[1] for r in rows}
            sample = [(text[i], y) for i, _, y in labels if i in text and zlib.crc32(str(i).encode()) % 5 != 0]
            lexicon = toxicity.learn(spark.createDataFrame(sample, "text string, y int"))
            weights, exceptions = plain_lexicon(sample)
            assert lexicon.weights.keys() == weights.keys() and set(lexicon.exceptions) == exceptions
            matched = [(plain_matched(w := plain_words(r[1]), weights, exceptions), len(w)) for r in rows]
            score = lexicon.scores(np.array([m for m, _ in matched]), np.array([n for _, n in matched], float))
            want = [r for r, s in zip(rows, score) if s < 0.5]
            assert {r[0] for r in rows} - {r[0] for r in want} >= {i for i, _, y in labels if y and i in text}
        elif name == "minhash_near_dedup":
            want = [r for r, (_, c) in zip(rows, brute_components([r[:2] for r in rows], 5, 80)) if r[0] is None or r[0] == c]
        else:
            kept = [brute_kept_text(r[1] or "", gone) if r[1] is not None else None for r, gone in zip(rows, brute_removed([r[:2] for r in rows]))]
            want = [(r[0], t, *r[2:4], None if t is None else len(t)) for r, t in zip(rows, kept)]
            assert want != rows
        assert order(now.collect()) == order(want), name
        assert 0 < len(want) <= len(rows)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert str(order(run[columns].itertuples(index=False))) == str(order(packed[columns].itertuples(index=False)))
    assert run.sequence_id.nunique() == packed.sequence_id.nunique()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_equally_near_neighbours_vote_in_order():
    """More copies of a vector than neighbours: the first ones in the sample vote."""
    k = quality_knn.NEIGHBOURS
    n = 65536 // 64
    space = quality_knn.Space(np.arange(n), np.ones(n), np.eye(n + quality_knn.RATIOS, 4), np.zeros(n + quality_knn.RATIOS), np.tile([[1.0, 0, 0, 0]], (3 * k, 1)), np.array([1.0] * 5 + [0.0] * (3 * k - 5)), 0.5)
    got = space.scores([b"some text", b"another one"])
    assert np.allclose(got, 5 / k)
