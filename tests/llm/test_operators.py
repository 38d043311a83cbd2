import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from partlens.llm import chat, exact, jaccard, licenses, lines, mixing, packing, quality, sentencepieces, suffixes
from partlens.llm.tables import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, token long, spans string"
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(seed, n, line=12):
    r = random.Random(seed)
    w = ["".join(r.choice(["er", "in", "the", "on", "at", "Ü", "es"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(w[i:i + line]) for i in range(0, n, line))


def messy():
    """Nulls, empty and very long texts, ties, repeated rows, near copies and shared passages."""
    passage = prose(7, 150)
    texts = [
        (1, prose(1, 120)), (2, prose(1, 120)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "One  two"), (None, prose(2, 60)),
        (8, prose(3, 40) + "\n" + passage + "\n" + prose(4, 40)), (9, passage), (10, prose(5, 30) + passage), (11, "a" * 1500), (12, "ab" * 5000),
        (13, prose(1, 120) + " extra"), (14, prose(1, 120).replace("the", "teh", 1)), (2, prose(1, 120)), (15, "漢字かな " * 300),
        (16, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\ncc by cc by"), (17, "x " * 30000), (18, "one\n\n\n\none\n\n"), (6, "one"),
    ]
    return [(k, t, None if i % 5 == 0 else "en", "s%d" % (i % 2), 0, i, "x", i, "y") for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- quality rules

def plain_measures(text):
    text = text or ""
    w = plain.WORD.findall(text)
    where = defaultdict(list)
    for i in range(len(w) - 4):
        where[tuple(w[i:i + 5])].append(i)
    covered = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    ls = [x for x in text.split("\n") if plain.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_quality_measures_and_base_rules(docs):
    got = by_row(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for r in messy():
        m = plain_measures(r[1])
        want[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want


def test_quality_fences_follow_the_source(spark):
    plainly = [(i, prose(i, 60), "en", "a", 0) for i in range(150)]
    tables = [(1000 + i, re.sub(" ", " | ", prose(5000 + i, 60)), "en", "b", 0) for i in range(150)]
    odd = [(2000, prose(9999, 60).replace(" ", "### "), "en", "a", 0)]
    df = spark.createDataFrame(plainly + tables + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality.filter_documents(df).collect()}
    assert kept == {r[0] for r in plainly + tables}  # what is usual in source b is not in source a


def test_quality_fences_take_upper_percentiles_and_shrink(spark):
    def fences(n):
        few = [(i, prose(i, 60).replace(" ", " # ", i % 5), "en", "few", 0) for i in range(n)]
        many = [(10_000 + i, prose(700 + i, 60), "en", "many", 0) for i in range(400)]
        df = spark.createDataFrame(few + many, "doc_id long, text string, lang string, source string, n_chars long")
        measured = df.select("lang", "source", quality.measures(df.text).alias("m"))
        return {r.source: r for r in quality.thresholds(quality.sketch(measured)).collect()}

    found = {n: fences(n) for n in (10, 99, 101, 400)}
    highs = [found[n]["few"].symbols_high for n in (10, 99, 101, 400)]
    assert highs[0] < min(highs[1:])  # ten documents say little against their language
    assert abs(highs[2] - highs[1]) <= 4  # no jump at a number of documents
    assert found[400]["many"].symbols_high < highs[-1] and found[400]["many"].repeats_high == 2 * quality.ROUNDING


def test_quality_filter_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, prose(1, 60), "en", "a", 5, "x", None), (2, "too short", None, None, 1, "y", 3)],
                               "doc_id long, text string, lang string, source string, m int, __fence string, document int")
    out = quality.filter_documents(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, prose(1, 60), "en", "a", 5, "x", None)]


def test_quality_filter_keeps_columns_and_empty_tables(docs, none):
    out = quality.filter_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in messy()}
    assert quality.judge(none).count() == 0 and quality.filter_documents(none).count() == 0


# --- packing

def test_packing_whole_corpus(docs, none):
    rows = packing.pack(docs, BPE).collect()
    texts = {(r[0], r[1]): r[1] for r in messy()}
    want = Counter()
    copies = Counter((r[0], r[1]) for r in messy())
    for (key, piece), found in plain.pieces(texts, Tokenizer.from_file(BPE)).items():
        want[(key[0], piece, *found)] += copies[key]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    gapless(rows)
    assert packing.pack(none, BPE).count() == 0


def gapless(rows, capacity=packing.CAPACITY):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_real_sequences(docs):
    packed = packing.pack(docs.where("doc_id < 12"), BPE, with_ids=True)
    lengths = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert sum(lengths.values()) == sum(r.length for r in packed.collect()) and max(lengths.values()) <= packing.CAPACITY


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_optimal_when_small(seed):
    r = random.Random(seed)
    capacity = 12
    items = [r.randint(1, capacity) for _ in range(9)]
    table = packing.plan(Counter(items), capacity)
    bins, used = defaultdict(int), Counter()
    for size in items:
        row = [x for x in table if x[0] == size and x[1] <= used[size]][-1]
        bins[row[3] + (used[size] - row[1]) // row[2]] += size
        used[size] += 1
    assert max(bins.values()) <= capacity

    def least(left, rooms):
        if not left:
            return len(rooms)
        best = least(left[1:], (*rooms, capacity - left[0])) if len(rooms) < len(bins) else len(bins)
        for i, room in enumerate(rooms):
            if room >= left[0]:
                best = min(best, least(left[1:], (*rooms[:i], room - left[0], *rooms[i + 1:])))
        return best

    fixed = dict(Counter(items))
    packing.reduce_instance(fixed, capacity)
    assert len(bins) <= least(sorted(items, reverse=True), ()) + 1
    if not fixed:  # everything was fixed by dominance, so the packing is as good as any
        assert len(bins) == least(sorted(items, reverse=True), ())


def test_encoder_is_exact_on_odd_texts():
    odd = ["", "  ", "a b  c", "don't we'll 's", "<|endoftext|> x<|endoftext|>y", "ΑΣ ΣΑ Σ", "İstanbul", "éa ́b", "a\x1cb\x1f c\x85d",
           "漢字かな123abc", "x" * 3000, "ñ'S É'T", "½ ² ３４", "ﬁn ẞ", "𝒜bc ǅ ŉ", "a\tb\r\nc\x0bd\x0ce", "a b c"]
    ids, starts = packing.WordEncoder(BPE).encode(pa.array(odd))
    whole = Tokenizer.from_file(BPE)
    assert [ids[s:e].tolist() for s, e in zip(starts, starts[1:])] == [whole.encode(x, add_special_tokens=False).ids for x in odd]


def test_tokenizer_is_given_bounded_batches():
    encoder, sizes = packing.WordEncoder(BPE), []
    real = encoder._tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **kwargs):
            sizes.append(len(texts))
            return real.encode_batch_fast(texts, **kwargs)

    encoder._tokenizer = Counted()
    text = " ".join("w" + "abcdefghij"[i % 10] * (i // 10 % 10 + 1) + chr(97 + i // 100 % 26) + chr(97 + i // 2600) for i in range(9000))
    ids, _ = encoder.encode(pa.array([text]))
    assert sum(sizes) > 8000 and max(sizes) <= 2048
    assert ids.tolist() == real.encode(text, add_special_tokens=False).ids


# --- exact dedup

def test_exact_owners(docs, none):
    groups = defaultdict(list)
    for r in messy():
        text = r[1] or ""
        groups[re.sub(r"[\x20\x09-\x0D]+", "", text)].append((-len(text), r[0] is None, r[0] or 0, r[0]))
    want = Counter((r[3], min(rows)[3], len(rows), r[3] == min(rows)[3], plain.sha(bare.encode())) for bare, rows in groups.items() for r in rows)
    assert by_row(exact.assign(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact.assign(none).count() == 0
    assert exact.dedup(docs).columns == docs.columns and exact.dedup(docs).select("text").distinct().count() == len(groups)


def test_trie_spills_subtrees_and_loses_nothing():
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(500)]
    trie, found = exact.Trie(), Counter()
    for i, text in enumerate(texts):
        trie.insert(text, (-len(text), i))
        if trie.size > 60:
            found.update({t: n.count for t, n in trie.spill()})
    for text, node in trie.terminals():
        found[text] += node.count
    assert found == Counter(texts)


# --- SentencePiece

@pytest.mark.parametrize("dictionary", (0, 50))
def test_sentencepiece_ids_and_round_trip(spark, docs, monkeypatch, dictionary):
    monkeypatch.setattr(sentencepieces, "DICTIONARY", dictionary)
    blanks = [(100 + k, " " * k + "zz x" + " " * (2 * k), None, None, 0, 0, "", 0, "") for k in range(1, 20)]
    df = docs.union(spark.createDataFrame([*blanks, (200, "a" * 300 + " zz.zz," * 9 + "\U0001F600\t\n", *[None] * 7), (201, "▁▁ ▁", *[None] * 7)], SCHEMA))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = Counter((k, len(ids := model.encode(t or "")), zlib.crc32(np.array(ids, dtype="<u2").tobytes()), True) for k, t in texts)
    assert by_row(sentencepieces.digest(df, PIECES), "doc_id", "n_tokens", "ids_crc32", "round_trip") == want


def test_viterbi_over_a_unigram_table(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    r = np.random.default_rng(1)
    for piece in proto.pieces:
        if piece.type == 1:
            piece.score = -float(np.float32(5 + 10 * r.random()))
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model, table = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepieces.Table.load(str(path), "unigram")
    words = sorted({w for w in table.words(prose(1, 200)) if w.startswith(sentencepieces.BLANK)})
    found = sentencepieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string").repartition("word"), table).collect()
    assert {x.word: list(x.ids) for x in found} == {w: model.encode(w[1:]) for w in words}


@pytest.mark.parametrize("kind", ("bpe", "unigram"))
def test_words_are_folded_alike_in_tasks_and_as_rows(spark, kind):
    table = sentencepieces.Table.load(PIECES, kind)
    words = sorted({w for t in [prose(1, 200), "漢字かな \U0001F600x" * 5, "a" * 90 + "▁" * 30, "don't 12,345.67 ▁▁▁ zz"] for w in table.words(t)})
    rows = sentencepieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string").repartition("word"), table).collect()
    fold = sentencepieces.local_fold(table)
    assert len(words) > 100
    assert {x.word: list(x.ids) for x in rows} == {w: np.frombuffer(fold(w), dtype="<u2").tolist() for w in words}


def test_dictionary_words_and_empty_texts():
    """The blank at the end of a text is a word; an empty text has none."""
    table = sentencepieces.Table.load(PIECES)
    fold, known = sentencepieces.local_fold(table), ["▁", "▁the", "."]
    encoder = sentencepieces.Encoder(pa.table({"word": known, "packed": [fold(w) for w in known]}), table)
    texts = ["", "the ", "the.", "a the, b"]
    assert encoder.of_texts(texts) == [b"".join(map(fold, table.words(t))) for t in texts]
    assert encoder.of_words(pa.array(["the", "the.", "x."])) == [b"".join(map(fold, table.words(t))) for t in ["the", "the.", "x."]]


def test_sentencepiece_texts_are_not_shuffled(docs):
    plan = sentencepieces.encode(docs, sentencepieces.Table.load(PIECES)).select("ids")
    before = docs.select("text").mapInArrow(lambda batches: batches, "text string")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(plan) == exchanges(before)
    assert sentencepieces.digest(docs, PIECES)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_sentencepiece_empty_table(none):
    assert sentencepieces.digest(none, PIECES).count() == 0


# --- n-gram Jaccard join

@pytest.mark.parametrize("size, part, block", ((3, 90, 2048), (5, 80, 3), (2, 50, 2)))
def test_jaccard_components(spark, monkeypatch, size, part, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    base = [prose(s, 80) for s in range(4)]
    r = random.Random(5)
    texts = {}
    for i in range(60):
        w = base[i % 4].split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = "new%d" % r.randrange(9)
        texts[i] = " ".join(w)
    texts |= {100: "One", 101: "one", 102: "one two", 103: "", 104: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.digest(df, size, part).collect()}
    assert got == plain.components(texts, size, part)


def test_jaccard_messy_and_empty(docs, none):
    out = jaccard.digest(docs)
    assert out.count() == len(messy())
    stay = jaccard.one_of_each(docs, 3, 90)
    assert stay.columns == docs.columns
    kept = [x.doc_id for x in stay.collect()]
    assert 1 in kept and 2 not in kept and {3, 4, 5} <= set(kept) and kept.count(6) == 2 and None in kept
    assert jaccard.digest(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    roots = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# --- suffix-array dedup

@pytest.mark.parametrize("group", (1, 20_000))
def test_suffix_dedup(docs, none, group):
    bodies = [(r[1] or "").encode() for r in messy()]
    want = Counter((*row, *shared[:2]) for row, shared in zip((
        (r[0], len(b), *cut[:2], plain.sha(cut[2])) for r, b, cut in zip(messy(), bodies, plain.repeated_strings(bodies))), plain.repeated_strings(bodies, 250)))
    assert by_row(suffixes.digest(docs, group), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "n_shared_spans") == want
    assert suffixes.digest(none, group).count() == 0


def test_suffix_cut_documents(docs, none):
    out = suffixes.cut_documents(docs)
    assert out.columns == docs.columns and out.count() == len(messy())
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] is None and texts[9] == "" and texts[6] == "one" and texts[16] == messy()[17][1]
    assert suffixes.cut_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_deep_shallow_sorting(seed):
    r = random.Random(seed)
    stem = b"z" * 100
    texts = [stem[: r.choice((0, 3, 100))] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(200)]
    order = suffixes.deep_shallow(texts)
    assert [texts[i] for i in order] == sorted(texts) and sorted(order) == list(range(200))


def test_shared_reach_against_all_pairs():
    r = random.Random(2)
    gram = b"g" * 4
    left = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(40)]
    right = [gram + bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(40)]
    got = suffixes.shared_reach(left, right, 9, 4)
    for i in range(40):
        hits = [(a, b) for j in range(40) if j != i for a, b in [(suffixes.common_prefix(left[i], left[j]), suffixes.common_prefix(right[i], right[j]))] if a + b >= 9]
        assert got[i] == ((9 - max(b for _, b in hits), max(a for a, _ in hits)) if hits else None)


# --- license scans

def test_license_labels(docs, none):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = rows[16]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (4, 3, 14, "cc-by,mit", "cc-by,cc-by-nc,mit", 1.0)
    assert (rows[3].n_words, rows[3].n_base, rows[3].first_word, rows[3].labels, rows[3].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(none).count() == 0


def test_license_join_finds_what_all_pairs_find(spark):
    r = random.Random(1)
    wordings = [w for _, w in licenses.TEMPLATES]
    texts = []
    for i in range(80):
        w = r.choice(wordings).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(["the", "x", "License"])
        r.shuffle(w)
        texts.append((i, prose(i, 30) + "\n" + " ".join(w) + "\n" + prose(i + 1, 100, 100)))
    got = {x.doc_id: (x.labels, x.score) for x in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        base = {x for p, x in licenses.PHRASES if " %s " % p in " %s " % " ".join(text.encode().translate(licenses._FOLD).decode().split())}
        labels, best = set(base), 1.0 if base else 0.0
        for block in licenses.blocks(text.encode()):
            for label, wording in licenses.TEMPLATES:
                words = set(wording.encode().translate(licenses._FOLD).split())
                share = len(words & block) / len(words)
                if share >= licenses.CONTAINMENT - 1e-9:
                    labels.add(label)
                    best = max(best, share)
        assert got[i] == (",".join(sorted(labels)), pytest.approx(best))


# --- line dedup

def test_line_dedup(docs, none):
    keyed = sorted({(r[0] is None, r[0] or 0, r[1]) for r in messy() if r[1] is not None}, key=lambda x: x[:2])
    want = plain.line_dedup([((k, t), t) for n, k, t in keyed])
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    copies = Counter((r[0] or 0, r[1]) for r in messy())
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == sum((Counter({(None if n else k, want[k, t]): copies[k, t]}) for n, k, t in keyed), Counter({(3, None): 1}))
    assert lines.dedup_lines(none).count() == 0 and lines.digest(none).count() == 0


def test_long_single_lines_are_deleted(spark):
    long = prose(3, 40, 40)
    short = "as seen before"
    texts = {1: f"alpha\n{long}\nbeta\n{short}", 2: f"gamma\n{long}\ndelta\n{short}\n", 3: long, 4: short, 5: f"{long}\n{long}\n{short}\nomega", 6: None, 7: ""}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert got == plain.line_dedup(list(texts.items()))
    assert got[2] == f"gamma\ndelta\n{short}\n" and got[3] == "" and got[4] == short and got[5] == f"{short}\nomega"


def test_line_matches_grow_to_both_sides(spark):
    body = [f"line {i}" for i in range(12)]
    texts = {1: body, 2: ["x", *body[2:9], "y", *body[7:12]], 3: ["z", *body[2:9]], 4: body[:1]}
    df = spark.createDataFrame([(k, "\n".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.lines, r.first_doc_id, r.first_start) for r in lines.matches(df).collect()}
    assert got == {(2, 1, 7, 1, 2), (2, 9, 5, 1, 7), (3, 1, 7, 1, 2)}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_of_drawn_texts(spark, seed):
    r = random.Random(seed)
    pool = ["", " ", "a", "b", "c", "x" * 100, "y " * 99, "z " * 100]
    texts = {k: "\n".join(r.choices(pool, k=r.randint(1, 9))) for k in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.text for x in lines.dedup_lines(df).collect()} == plain.line_dedup(list(texts.items()))


# --- chat formatting

def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 2, "ann", "Yes"), (1, 2, "ann", "Yes"), (2, 0, "system", "x"), (None, 0, None, "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.perspective): r for r in chat.dialogues(df).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = found[1, "ann"]
    assert ann.text == ("<|system|>\nBe kind\n<|end|>\n<|assistant|>\nHi\n<|end|>\n<|assistant|>\nYes\n<|end|>\n<|assistant|>\nYes\n<|end|>\n"
                        "<|user|> name=bob\n\n<|end|>\n")
    assert [ann.text[s.start:s.end] for s in ann.spans] == ["Hi\n<|end|>\n", "Yes\n<|end|>\n", "Yes\n<|end|>\n"]
    assert chat.dialogues(df.where("turn > 5")).count() == 0


def test_long_conversations_come_in_segments(spark):
    df = spark.createDataFrame([(1, t, "a" if t % 3 else "b", str(t)) for t in range(200)], "conv_id long, turn long, role string, text string")
    found = sorted((r.perspective, r.segment, r.n_turns, r.text) for r in chat.dialogues(df).collect())
    assert [x[1:3] for x in found if x[0] == "a"] == [(0, 64), (1, 64), (2, 64), (3, 8)]
    assert re.findall(r"\n(\d+)\n", "".join(x[3] for x in found if x[0] == "b")) == [str(t) for t in range(200)]


# --- language-model scores

def test_base_scores(docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "DICTIONARY", 20)
    texts = [(r[0], plain.WORD.findall((r[1] or "").translate(plain.SMALL)) + [None]) for r in messy()]
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in texts}
    counts = Counter(w for k, ws in texts if not held[k] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((k if k is not None else -1, held[k], len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 4)) for k, ws in texts)
    found = mixing.score(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)
    assert mixing.score(none).count() == 0


def test_model_learns(spark):
    """Held-out texts of the trained kind cost less than others, and clearly less than their letters at random."""
    r = random.Random(1)
    rows = [(i, prose(i % 40, 200)) for i in range(400)] + [(1000 + i, "".join(r.choice("qwxzkjvy ") for _ in range(900))) for i in range(20)]
    found = [r for r in mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    alike, odd = [r.bits_per_byte for r in found if r.doc_id < 1000], [r.bits_per_byte for r in found if r.doc_id >= 1000]
    assert alike and max(alike) < 1.0 and (not odd or min(odd) > 2 * max(alike))
    assert all(r.score > r.base_score for r in found if r.doc_id < 1000)


def test_code_of_ranks_is_complete():
    """The bits of a rank tell it apart: walks and free digits give probabilities that sum to one at the even mix."""
    ranks = np.arange(-1, 5000)
    nodes, bits, size, free = mixing._bits_of(ranks)
    ends = np.cumsum(size)
    share = Counter()
    for s, e, f in zip(ends - size, ends, free):
        share[tuple(zip(nodes[s:e].tolist(), bits[s:e].tolist()))] += 2.0 ** -f
    assert max(share.values()) <= 1.0
    assert all(not set(b).issuperset(a) for a in list(share)[:40] for b in share if a != b)


def small_model(texts):
    """Model of texts, and their tokens with indices in the dictionary, without Spark."""
    column = pa.array([t.encode() for t in texts], pa.binary())
    tokens = mixing._tokens(column)
    dictionary = mixing.Dictionary(*np.unique(tokens[1], return_counts=True))
    mixing._held["small"] = dictionary
    share = type("Share", (), {"key": "small"})
    batch = pa.RecordBatch.from_pydict({"body": column})
    parts = [x for b in mixing._merge(mixing._train(share)([batch])) for x in b.to_pylist()]
    return mixing.Model(dictionary, {x["part"]: zlib.decompress(x["counts"]) for x in parts}), batch, tokens, dictionary.find(tokens[1])


def test_mixing_learns_through_the_whole_text():
    """Every bit changes what the next ones of its text meet, far beyond any stretch; read here one by one."""
    texts = [prose(1, 700), prose(2, 5), "", prose(1, 300) + " " + prose(3, 90)]
    model, _, tokens, at = small_model(texts)
    start = mixing.State.of({0: 0.7, 5: 0.1, mixing._ORDERS * mixing._GATES + 40: 0.2})
    got, *_ = mixing._mixed(model, start, len(texts), tokens, at)
    nodes, bit, size, _ = mixing._bits_of(model.dictionary.rank(at))
    x, seen = mixing._inputs(model, mixing._contexts(*tokens[:2]), nodes, bit, size, False)
    level = np.concatenate([np.arange(k) for k in size])
    rows = np.repeat(tokens[0], size)
    for row in range(len(texts)):
        weights, refined, cost = start.weights.astype(float), start.refined.reshape(-1, mixing._BINS).astype(float), 0.0
        for i in np.flatnonzero(rows == row):
            gate = level[i] * 4 + min((int(seen[i]) + 1) // 2, 3)
            logit = float(np.clip(weights[:, gate] @ x[:, i], -8, 8))
            p, spot = 1 / (1 + math.exp(-logit)), int((logit + 8) * (mixing._BINS - 1) / 16 + 0.5)
            q = (p + refined[level[i], spot]) / 2
            cost -= math.log2(q if bit[i] else 1 - q)
            weights[:, gate] += mixing.RATE * (bit[i] - p) * x[:, i]
            refined[level[i], spot] += mixing.MAP_RATE * (bit[i] - refined[level[i], spot])
        assert got[row] == pytest.approx(cost, rel=2e-3)


def test_training_texts_teach_the_mix(spark):
    """The state that texts start from is learned over all training texts, and helps texts of their kind."""
    texts = [prose(i % 12, 150) for i in range(60)]
    model, _, tokens, at = small_model(texts)
    df = spark.createDataFrame([(t.encode(),) for t in texts], "body binary").repartition(3)
    state = mixing.learned(df, mixing._Share(spark, model))
    first = mixing.State.initial()
    assert not np.allclose(state.weights, first.weights, atol=0.01) and not np.allclose(state.refined, first.refined, atol=0.01)
    taught, untaught = (mixing._mixed(model, s, len(texts), tokens, at)[0].sum() for s in (state, first))
    assert taught < untaught


def test_every_digit_of_a_rank_is_modelled():
    ranks = np.array([-1, *range(3000), (1 << 19) - 1, 1 << 18, 300_000, 500_001])
    nodes, _, size, free = mixing._bits_of(ranks)
    assert not free.any() and max(size) <= mixing._DEPTH
    assert size.tolist() == [mixing._LEVELS + (0 if r < 0 else int(r + 1).bit_length() - 1) for r in ranks]
    kinds = np.unique(nodes)
    slots = mixing._slots(0, np.zeros(len(kinds), np.uint64), kinds)
    assert len(set(slots.tolist())) == len(kinds) and slots.max() < mixing.SLOTS


def test_contexts_tell_words_of_one_bucket_apart():
    """Of 64 equally frequent words, the one that follows the word before costs less than all others."""
    words = ["w%02d" % i for i in range(64)]
    texts = ["new york " + " ".join(f"{w} {w}" for w in words)] * 20 + [f"new {w}" for w in ["york", *words[:-1]]]
    model, _, tokens, at = small_model(texts[:20])
    _, batch, tokens, _ = small_model(texts)
    cost = mixing.bits(model, mixing.State.initial(), len(texts), tokens, model.dictionary.find(tokens[1]))[20:]
    assert cost[0] + 2 < min(cost[1:])


@pytest.mark.parametrize("width", (60, 70, 80))
@pytest.mark.parametrize("lead", ("", "# ", " * "))
def test_wrapped_notices_are_found(spark, width, lead):
    """Every template has its label when it is wrapped over lines between others, also in a comment header."""
    rows = [(i, "\n".join([prose(i, 90), *(lead + x for x in textwrap.wrap(wording, width - len(lead))), prose(i + 50, 90)]))
            for i, (_, wording) in enumerate(licenses.TEMPLATES)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in found[i].labels.split(",") and found[i].score == 1.0
