"""Each operator on awkward and on empty tables, against plain versions."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nightframe.llm import chat, counting, decontaminate, mixing, personal, pieces, quality, repeats, sharding, simhash, tokens
from nightframe.llm.suffixes import front_code, merge
from nightframe.llm.tagger import Tagger
from nightframe.llm.wavelet import WaveletMatrix
from tests.llm.helpers import awkward, prose, rows, texts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# 1 -- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and personal.luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    import random

    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab1.25@%+- ()9é") for _ in range(rng.randrange(70)))
        assert personal.base_spans(text) == plain_spans(text)
    text = "x 4111 1111 1111 1111 y a@b.c%x@d.e 1.2.3.4.5.6.7.8 +1 (212) 555-0199 999.1.1.1"
    assert personal.base_spans(text) == plain_spans(text) and len(plain_spans(text)) == 5


def telling(i):
    n = f"{i % 90 + 10}"
    kinds = [f"ab.{n}@mail{i % 7}.example.com", f"{n}.17.{i % 200}.4", "4111111111111111", f"+1 (2{n}) 555-01{n}"]
    return f"{prose(i, 30)} {kinds[i % 4]} {prose(i + 1, 30)} {kinds[(i + 1) % 4]} version 3.1 {prose(i + 2, 20)}"


def test_personal_data_model_and_awkward_rows(spark, docs, empty):
    known = spark.createDataFrame([(i, telling(i)) for i in range(160)], "doc_id long, text string")
    model = personal.train(known)
    held = [telling(i) for i in range(1000, 1060)]
    found = personal.model_spans(held, model)
    truth = [set(plain_spans(t)) for t in held]
    hit = sum(len(t & set(f)) for t, f in zip(truth, found, strict=True))
    assert hit >= 0.85 * sum(map(len, truth)) and hit >= 0.95 * sum(map(len, found))
    # windows without digits or at signs cannot add a span
    assert personal.model_spans(held[:10], model, every=True) == found[:10]
    got = personal.found(docs.select("doc_id", "text").unionByName(known), model).collect()
    assert len(got) == docs.count() + 160
    texts_of = {r["doc_id"]: r["text"] for r in known.collect()}
    for r in got:
        if r["doc_id"] in texts_of and r["doc_id"] > 40:
            assert r["base"] == personal.joined(plain_spans(texts_of[r["doc_id"]]))
            assert set(r["base"].split(",")) <= set(r["spans"].split(","))
    assert rows(personal.report(docs).filter("n_email + n_ip + n_card + n_phone + n_added > 0")) == []
    assert personal.report(empty).count() == 0


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 98, (3, 7)), rng.integers(0, 9, (3, 7))
    model = Tagger()
    _, grads = model.loss(x, y)
    for name in model.p:
        spot = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        model.p[name][spot] += 1e-5
        up = model.loss(x, y)[0]
        model.p[name][spot] -= 2e-5
        down = model.loss(x, y)[0]
        model.p[name][spot] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][spot]) < 1e-5


# 2 -- chat

HARD = ["", "<", "<|", "<\\|im_end|>", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nhi", "a<|im_end|", "\\", "<\\\\|", "x\n\n", "<|im_start|>", "<<|im_end|>>"]


def test_turns_come_back():
    for role in (*HARD, "user", "assistant", "a\nb"):
        for text in HARD:
            shown = chat.render(role, text)
            assert [t[:2] for t in chat.parse(shown)] == [(role, text)]
            assert shown.count("<|im_end|>") == 1 == shown.count("<|im_start|>")
    whole = "".join(chat.render("user", t) for t in HARD)
    assert [t[1] for t in chat.parse(whole)] == HARD
    assert chat.render("user", "plain <b| text") == "<|im_start|>user\nplain <b| text<|im_end|>\n"
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\nhi")


def test_chat_rows(spark):
    given = [(1, 1, "assistant", HARD[5]), (1, 0, "user", None), (2, 0, None, "x"), (None, 3, "assistant", "y"), (None, None, "user", "z")]
    given += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    want = {1: [("user", ""), ("assistant", HARD[5])], 2: [("", "x")], None: [("user", "z"), ("assistant", "y")], 3: [("assistant", "same")] * 2}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.render(a, t)) for a, t in turns)
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


# 3 -- repeats


def plain_repeats(given, least):
    count = Counter(b[i : i + least] for b in given for i in range(len(b) - least + 1))
    out = []
    for b in given:
        cover = np.zeros(len(b), int)
        for i in range(len(b) - least + 1):
            if count[b[i : i + least]] > 1:
                cover[i : i + least] = 1
        spans = int((np.diff(np.concatenate(([0], cover))) == 1).sum())
        out.append((len(b), int(cover.sum()), spans, bytes(np.frombuffer(b, np.uint8)[cover == 0])))
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeats_equal_brute_force(docs, crowd):
    own = texts(docs)
    want = plain_repeats([(t or "").encode() for _, t in own], 400)
    got = repeats.deduplicated(docs, crowd=crowd)
    assert rows(got) == sorted([(d, *w) for (d, _), w in zip(own, want, strict=True)], key=str)


def test_repeats_in_patched_texts(spark):
    """Pieces of a few passages joined at random, so matches start and end everywhere."""
    import random

    rng = random.Random(5)
    passages = [prose(100 + i, 200) for i in range(6)]
    given = ["".join(p[(a := rng.randrange(600)) : a + rng.randrange(900)] for p in rng.choices(passages, k=4)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    want = sorted([(i, *w) for i, w in enumerate(plain_repeats([t.encode() for t in given], 96))], key=str)
    assert sum(w[2] for w in want) > 100
    for anchor, crowd in ((32, 2000), (64, 5)):
        assert rows(repeats.deduplicated(df, 96, anchor, crowd)) == want


@pytest.mark.parametrize("crowd", [10**6, 3])
def test_repeats_are_judged_by_bytes_in_groups_of_any_size(spark, crowd):
    """Hashes of three bits put nearly everything into a few groups; one passage has more places in a run than travel with it."""
    import random

    rng = random.Random(7)
    common = prose(200, 60)
    given = [prose(300 + i, 10 + rng.randrange(30)) + common + prose(400 + i, 30) for i in range(60)] + [common[20:]] * 40 + [prose(500 + i, 60) for i in range(20)]
    given += [prose(600, 80), prose(601, 80) + prose(600, 80)[100:300], None, "x"]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(given)], "doc_id long, text string").repartition(3)
    own = texts(df)
    want = plain_repeats([(t or "").encode() for _, t in own], 100)
    assert sum(w[1] > 0 for w in want) > 100 and sum(w[1] == 0 for w in want) > 20
    assert rows(repeats.deduplicated(df, 100, 40, crowd, bits=3)) == sorted([(d, *w) for (d, _), w in zip(own, want, strict=True)], key=str)


def test_a_hot_anchor_is_joined_where_its_rows_lie(spark):
    """Half of all anchors have one hash; rows of one key and text count, but are listed once."""
    given = spark.range(4000, numPartitions=8).selectExpr("IF(id % 2 = 0, -1, id % 999) AS hash", "id % 5 AS around", "id % 400 AS k_id", "0L AS k_text", "id % 3 AS place")
    marked = repeats._marked(given, 10**6, 10**6)
    hot = marked.filter("hash = -1").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in hot) == 2000 and max(r["count"] for r in hot) <= 250
    assert marked.count() == 4000 and {(r["crowded"], r["n"]) for r in repeats._marked(given, 10**6, 1999).groupBy("crowded").agg(F.count("*").alias("n")).collect()} == {(True, 2000), (False, 2000)}
    for r in repeats._by_text(marked).collect():
        assert r["crowd"] == [] and len({tuple(x) for x in r["places"]}) == len(r["places"])


def test_repeats_empty(empty):
    assert repeats.deduplicated(empty).count() == 0


def test_merge_equals_sort():
    import random

    rng = random.Random(2)
    entries = [(bytes(rng.choices(b"ab", k=rng.randrange(9))), bytes(rng.choices(b"xy", k=1)), [i]) for i in range(500)]
    for k in (1, 2, 5, 8):
        runs = [front_code(sorted(entries[i::k], key=lambda e: e[:2])) for i in range(k)]
        out, last = [], b""
        for shared, key, left, places in merge(runs):
            assert key[:shared] == last[:shared] and (shared == len(key) or shared == len(last) or key[shared] != last[shared])
            out += [(key, left, p) for p in places]
            last = key
        assert sorted(out) == sorted((a, b, p) for a, b, c in entries for p in c)
        assert [o[:2] for o in out] == sorted(o[:2] for o in out)


# 4 -- decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_contamination_equals_brute_force(spark, docs, empty):
    own = texts(docs)
    long, base = own[9][1], own[0][1]
    items = [(1, long[100:400]), (2, base), (3, "one TWO"), (4, None), (5, ""), (None, base), (6, "ÀB é ab"), (6, "ÀB é ab"), (10, "zzz yyy"), (7, "la la la")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    win = [(i, tuple(w[s : s + min(10, len(w))])) for i, t in items if (w := plain_words(t)) for s in range(len(w) - min(10, len(w)) + 1)]
    want = []
    for d, t in own:
        w, hit, found = plain_words(t), set(), set()
        for i, g in win:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found |= {str(i)} if i is not None else set()
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = rows(decontaminate.contamination(docs, bench))
    assert got == sorted(want, key=str) and sum(w[5] for w in want) > 5
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0


# 5 -- mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else share * weight[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def test_mix(spark, docs, empty):
    got = mixing.mixed(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    sizes, counted = Counter(), docs.select("source", "text").collect()
    for r in counted:
        sizes[r["source"]] += len(re.findall(SPACE, r["text"] or ""))
    target = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    out = mixing.mixed(docs)
    assert out.count() == docs.count() and rows(out) == rows(mixing.mixed(docs.repartition(7)))
    plan = {(r["doc_id"], r["size"]): r["copies"] for r in out.collect()}
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out.collect()) and plan
    assert mixing.mixed(empty).count() == 0 == mixing.repeated(empty).count()


def test_mix_hits_targets(spark):
    given = [(i, prose(i, 20 + i % 60), f"s{i % 7 if i % 3 else 0}") for i in range(900)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = mixing.mixed(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"))
    assert all(abs(r["n"] - r["t"]) <= 40 for r in got.collect())


# 6 -- SimHash


def plain_fingerprint(text):
    w = re.findall(SPACE, (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(docs, empty):
    own = texts(docs)
    fps = [plain_fingerprint(t) for _, t in own]
    comp = plain_components(fps)
    least = {c: min((d for (d, _), k in zip(own, comp, strict=True) if k == c and d is not None), default=None) for c in comp}
    want = sorted([(d, f"{f:016x}", least[c]) for (d, _), f, c in zip(own, fps, comp, strict=True)], key=str)
    assert rows(simhash.components_of(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    assert simhash.components_of(empty).count() == 0


def test_near_copies_of_five_words_and_four_fifths_are_grouped(spark, docs, empty):
    """Lone copies with words replaced, at a five-word similarity just above 0.8: about four of five share their original's root."""
    import random

    rng, own, similar = random.Random(5), [], 0
    for i in range(120):
        words = prose(1000 + i, 260).split()
        copy = list(words)
        for at in rng.sample(range(260), 5):
            copy[at] = f"changed{i}x{at}"
        five = [{tuple(w[k : k + 5]) for k in range(256)} for w in (words, copy)]
        similar += len(five[0] & five[1]) / len(five[0] | five[1]) >= 0.8
        own += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    df = spark.createDataFrame(own, "doc_id long, text string")
    root = {r["doc_id"]: r["root"] for r in simhash.near_groups(df).collect()}
    assert similar > 100 and sum(root[2 * i] == root[2 * i + 1] for i in range(120)) >= 84
    assert len({root[2 * i] for i in range(120)}) == 120  # originals stay apart
    kept = simhash.keep_near(docs.withColumn("a.b", F.lit(1)))
    assert kept.columns == [*docs.columns, "a.b"] and 0 < kept.count() < docs.count()
    assert simhash.keep_near(empty).count() == 0


def test_fingerprints_do_not_depend_on_chunks_and_order():
    text = prose(4, 3000).encode()
    words = text.lower().split()
    hashes = np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 2]), 42) for i in range(len(words) - 1)], np.uint64))
    for table, fp in enumerate(simhash.set_fingerprints(text)):
        own = simhash._remixed(hashes, table)
        bits = [2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own) for b in range(64)]
        assert fp % 2**64 == sum(1 << b for b, on in enumerate(bits) if on)
    assert simhash.set_fingerprints(None) == [0] * 4 == simhash.set_fingerprints(b" \n")


def test_keep_one_keeps_one_of_each_component(spark):
    far = [prose(700 + i, 80) for i in range(6)]
    own = [(None, far[0]), (None, far[1]), (None, far[1]), (None, far[2] + " "), (7, far[2]), (8, far[3]), (8, far[4]), (8, far[4]), (None, far[5]), (9, far[5])]
    kept = simhash.keep_one(spark.createDataFrame(own, "doc_id long, text string"))
    assert rows(kept) == sorted([(None, far[0]), (None, far[1]), (7, far[2]), (8, far[3]), (8, far[4]), (9, far[5])], key=str)


@pytest.mark.parametrize("crowd", [512, 2])
def test_links_lose_nothing(spark, crowd):
    import random

    rng = random.Random(9)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(8)}
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(nodes, crowd=crowd).collect()} == want and want


# 7 -- token shards


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), rng.integers(0, 300, 1000).astype(np.uint32), np.full(130, 7, np.uint32)):
        m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
        assert m.tokens().tolist() == ids.tolist()
        assert [m.access(i) for i in range(0, len(ids), 13)] == ids[::13].tolist()
        for token in {*ids[:5].tolist(), 299, 100000}:
            assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()
            assert m.count(token, len(ids) // 3, len(ids)) == int((ids[len(ids) // 3 :] == token).sum())


def test_pieces_equal_whole_texts():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    enc = pieces.Encoder(TOKENIZER)
    for text in [prose(1, 200), " a  b ", "x\n y\t z", "a \x1c b", "é  ñ  ", "don't  'll 12 3.4 <|endoftext|> <|endoftext|>x", "\n\n \n", "", " ", "a  b c"]:
        assert "".join(pieces.parts(text)) == text
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_shards(docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    own = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in own}
    got = sorted((tuple(r) for r in tokens.tokenized(docs, TOKENIZER).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [d for d, _ in own]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((d or -1, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in own)
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    small = tokens.read_back(tokens.shards(docs, TOKENIZER, shard_tokens=500))
    assert sorted(r[2] for r in small.collect()) == sorted(r[2] for r in got)
    assert tokens.tokenized(empty, TOKENIZER).count() == 0


# 8 -- counts that follow edits


def test_edits_equal_encoding_anew():
    import random

    rng = random.Random(4)
    coder = pieces.Encoder(TOKENIZER)
    for n in (0, 3, 200, 3000):
        text = prose(n, n)
        tree = counting.CountTree.build(text, coder)
        for _ in range(60):
            a = rng.randrange(len(text) + 1)
            b = a + rng.choice((0, 1, 5, 300))
            new = rng.choice(("", " ", "x", " y", "z ", "\n", prose(a, 3), prose(a, 200), " \n "))
            text, coded = tree.replace(text, a, b, new, coder)
            assert (tree.chars, tree.tokens) == (len(text), coder.count(text))
            assert sum(tree.leaves()[0]) == len(text) and sum(tree.leaves()[1]) == tree.tokens


def test_edited_counts(docs, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    own = docs.select("doc_id", "text")
    given = counting.sample_edits(own)
    got = rows(counting.edited(counting.trees(given, TOKENIZER), TOKENIZER).select("doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens"))
    want = []
    for r in given.collect():
        text = r["text"] or ""
        before = (len(text), size(text))
        for e in r["edits"]:
            text = text[: e["start"]] + e["new"] + text[max(e["start"], e["stop"]) :]
        want.append((r["doc_id"], *before, len(text), size(text)))
    assert got == sorted(want, key=str)
    assert counting.edited(counting.trees(counting.sample_edits(empty.select("doc_id", "text")), TOKENIZER), TOKENIZER).count() == 0


# 9 -- quality


def plain_measures(text):
    text = text or ""
    w = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    again = {p for i, t in enumerate(tri) if seen[t] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality(docs, empty):
    got = rows(quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for d, t in texts(docs):
        m = plain_measures(t)
        want.append((d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want, key=str)
    accepted = quality.accepted(docs)
    assert accepted.columns == docs.columns and accepted.count() == quality.judged(docs).filter("kept").count() > 0
    stored = quality.ledger(docs).cache()
    capitals = spark.createDataFrame([(1, "LOUD WORDS " * 40), (2, "quiet words " * 40), (3, "A b " * 60)], "doc_id long, text string")
    bit = quality.bits(("capitals",))
    assert [bool(r["failed"] & bit) for r in quality.ledger(capitals).orderBy("doc_id").collect()] == [True, False, False]
    assert quality.POLICIES["v1"][-1] == "duplicate_lines_third" and "shouting" not in quality.POLICIES[quality.CURRENT]
    dotted = docs.withColumn("a.b", F.lit(1))
    assert quality.accepted(dotted).columns == dotted.columns
    for r in quality.ablations(stored, "v2").collect():
        bit = quality.bits((r["rule"],))
        fails = [x["failed"] for x in stored.collect()]
        assert r["rejected"] == sum(f & bit != 0 for f in fails) and r["rejected_alone"] == sum(f == bit for f in fails)
        assert r["kept_without"] == sum(f & ~bit == 0 for f in fails)
    assert quality.judged(empty).count() == 0 == quality.ablations(quality.ledger(empty), "v2").count()


def test_quality_capitals_policies_and_ablations(spark, docs, empty):
    """What ``test_quality`` does not come to, as it takes no ``spark``."""
    stored = quality.ledger(docs).cache()
    capitals = spark.createDataFrame([(1, "LOUD WORDS " * 40), (2, "quiet words " * 40), (3, "A b " * 60)], "doc_id long, text string")
    bit = quality.bits(("capitals",))
    assert [bool(r["failed"] & bit) for r in quality.ledger(capitals).orderBy("doc_id").collect()] == [True, False, False]
    assert quality.POLICIES["v1"][-1] == "duplicate_lines_third" and "shouting" not in quality.POLICIES[quality.CURRENT]
    dotted = docs.withColumn("a.b", F.lit(1))
    assert quality.accepted(dotted).columns == dotted.columns
    fails = [r["failed"] for r in stored.collect()]
    for policy in quality.POLICIES:
        for r in quality.ablations(stored, policy).collect():
            bit, every = quality.bits((r["rule"],)), quality.bits(quality.POLICIES[policy])
            own = [f & every for f in fails]
            assert r["rejected"] == sum(f & bit != 0 for f in own) and r["rejected_alone"] == sum(f == bit for f in own)
            assert r["kept_without"] == sum(f & ~bit == 0 for f in own)
    assert quality.judged(empty).count() == 0 == quality.ablations(quality.ledger(empty), "v2").count()
    stored.unpersist()


# 10 -- shards


def test_ring_shards(spark, docs, empty):
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, prose(i % 40, 30)) for i in range(1500)], "doc_id long, text string"))
    got = sharding.assign(many, shards=8).collect()
    own = texts(many)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in own), key=str)
    by = Counter()
    for r in got:
        by[r["shard"]] += r["size"]
    most = max(r["size"] for r in got)
    assert max(by.values()) <= sum(by.values()) / 8 * 1.0005 + most and set(by) == set(range(8))
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert rows(sharding.assign(many.repartition(5), shards=8)) == sorted((tuple(r) for r in got), key=str)
    assert sharding.assign(empty).count() == 0


def test_ring_moves_little():
    totals = {c: 100 for c in range(sharding.CELLS)}

    def owner(shards):
        pieces_ = sharding.plan(totals, shards, 0.05, sharding.ring(shards))
        return {(c, x): s for c, a, b, s in pieces_ for x in range(a, b)}

    old, new = owner(8), owner(9)
    assert sum(old[k] != new[k] for k in old) < 0.35 * len(old)
    assert json.dumps(sorted(Counter(new.values()))) == json.dumps(list(range(9)))
