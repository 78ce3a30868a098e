"""Document operators against brute force, and on odd input."""

import hashlib
import random
import re

import pytest
import regex
import tiktoken
from fixtures import (
    BIG_ID,
    DOC_SCHEMA,
    components_of,
    odd_documents,
    plain_all_spans,
    plain_masked,
    plain_mentions,
    plain_patterns,
    plain_spans,
    prose,
    repeat_words,
    sha,
    shingle_set,
    words_of,
)

import public_tokenizers
from quorica.llm import bpe, language_id, licenses, minhash, mixing, pii, quality_model, quality_rules
from quorica.llm.common import prepared
from quorica.llm.queries import TOKEN_RANKS


@pytest.fixture(scope="module")
def odd(spark):
    prepared(spark)
    return spark.createDataFrame(odd_documents(), DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, q, 0) for i, q in ((4, 0), (5, 1), (6, 1), (7, None), (None, 1), (BIG_ID, 1), (5, 1), (99, 0))]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path(TOKEN_RANKS), public_tokenizers.PATTERN)


def reports(labels, vocabulary):
    return {
        "quality_model": lambda d: quality_model.quality_scores(d, labels),
        "quality_rules": quality_rules.quality_report,
        "licenses": lambda d: licenses.scan(d, licenses.known_licenses(d.sparkSession)),
        "bpe": lambda d: bpe.round_trip_report(d, vocabulary),
        "minhash": lambda d: minhash.near_duplicates(d, width=2),
        "pii": pii.pii_report,
        "mixing": mixing.mix_report,
        "language_id": language_id.languages_of,
    }


NAMES = ["quality_model", "quality_rules", "licenses", "bpe", "minhash", "pii", "mixing", "language_id"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_and_empty_tables_give_one_row_a_document(odd, empty, labels, vocabulary, name):
    run = reports(labels, vocabulary)[name]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in run(odd).select("doc_id").collect())
    assert got == sorted((r[0] is None, r[0] or 0) for r in odd_documents())
    assert run(empty).count() == 0


def test_stages_keep_columns_and_take_odd_input(odd, empty):
    stages = [
        quality_rules.keep_good,
        minhash.drop_near_duplicates,
        pii.redact,
        mixing.mix,
    ]
    for stage in stages:
        for docs in (odd, empty):
            out = stage(docs)
            assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()


def test_rule_statistics_against_brute_force(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    texts += ["a b c d e f g h\nx\n" * 4 + " | # x\n\n  \nx", "", "\n", prose(5, 3000, 30), "é# ü & 漢 <b>"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality_rules.quality_report(docs).collect():
        text = texts[r.doc_id]
        lines = [x for x in text.split("\n") if words_of(x)]
        assert r.n_words == len(words_of(text))
        assert r.word_chars == sum(map(len, words_of(text)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_words(text)


def test_cutoffs_follow_the_group(spark):
    """What is normal for one source is an outlier in another; small groups take their language's cutoffs."""
    clean = [(i, prose(i, 60, 50), "en", "plain") for i in range(300)]
    tables = [(1000 + i, " | ".join(prose(i, 60, 50).split()), "en", "tables") for i in range(300)]
    odd_one = [(5000, " | ".join(prose(1, 60, 50).split()), "en", "plain"), (5001, prose(2, 60, 50), "en", "small")]
    docs = spark.createDataFrame(clean + tables + odd_one, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_report(docs).collect()}
    assert not kept[5000] and kept[5001]
    assert sum(kept[i] for i in range(300)) >= 295 and sum(kept[1000 + i] for i in range(300)) >= 295


def near_copies(seed, n, length=80, edits=5):
    draw = random.Random(seed)
    origin = prose(seed, length, 500).split()
    made = []
    for _ in range(n):
        copy = list(origin)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(length)] = f"new{draw.random()}"
        made.append(" ".join(copy))
    return made


@pytest.mark.parametrize("members", [256, 8])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, members):
    """With families cut into chunks of 8 the hub and remainder rounds run too."""
    monkeypatch.setattr(minhash, "FAMILY_MEMBERS", members)
    monkeypatch.setattr(minhash, "HUBS", 2)
    texts = near_copies(1, 70) + near_copies(2, 5) + [prose(50 + i, 90, 400) for i in range(40)]
    texts += [texts[0]] * 40 + ["", None, "one", "one", "One"]
    docs = list(enumerate(texts))
    random.Random(0).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = components_of(sorted(docs), 2)
    got = minhash.near_duplicates(frame, width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t, 2)) for i, t in docs}
    left = {r.doc_id for r in minhash.drop_near_duplicates(frame, width=2).collect()}
    assert left == set(want.values())


def test_repeated_rows_leave_one(odd):
    left = minhash.drop_near_duplicates(odd, width=2).select("doc_id", "text").collect()
    assert sum(r.doc_id == 5 for r in left) == 1
    assert not any(r.doc_id in (6, 7, 8) for r in left)
    assert BIG_ID in [r.doc_id for r in left] and BIG_ID + 1 not in [r.doc_id for r in left]


def test_min_max_estimates_are_unbiased():
    hasher = minhash.MinMax(400, 5)
    a = minhash.shingles(" ".join(f"w{i}" for i in range(400)), 1)
    b = minhash.shingles(" ".join(f"w{i}" for i in range(100, 500)), 1)
    same = (hasher.ends(a) == hasher.ends(b)).mean()
    assert abs(same - 300 / 500) < 0.06


def test_encoding_and_decoding_against_the_library(odd, vocabulary):
    coder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )
    rows = [(r[0], r[1] or "") for r in odd_documents()]
    ids = [(i, t, coder.encode_ordinary(t)) for i, t in rows]
    want = sorted(str((i, len(x), sha(" ".join(map(str, x))), sha(t))) for i, t, x in ids)
    got = bpe.round_trip_report(odd, vocabulary).collect()
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == want


def test_blocks_and_packing(spark, vocabulary, monkeypatch):
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 32) - 1])
    assert bpe.unpack(bpe.pack(values)).tolist() == values.tolist()
    assert bpe.unpack(bpe.pack(np.array([], int))).tolist() == []
    for slots in ([], [0], [0, 0, 1, 0, 2, 2, 1, 3], list(range(300)) + [0, 299, 300]):
        assert bpe.unpack_slots(bpe.pack_slots(np.array(slots, int))).tolist() == slots
    assert bpe._unpress(*bpe._press(b"", b"a" * 1000)) == [b"", b"a" * 1000]
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(30)], "doc_id long, text string").coalesce(1)
    decoded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in decoded} == {i: prose(i, 50) for i in range(30)}
    # The same from blocks of a document or two, between which the numbers of pieces differ.
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 400)
    again = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in again) == sorted((r.doc_id, list(r.ids)) for r in decoded)


def test_base_spans_against_plain_patterns():
    draw = random.Random(4)
    pieces = ["a", "@", "b.c", ".", "1", "25", "300", "4111 1111 1111 1111", "+1 (555) 010-9999", "-", " ", "_", "é", "x@y.zz", "10.0.0.1", "%"]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_read_once():
    for text in ("a" * 2_000_000, "@" * 300_000, "a@" * 200_000, "1" * 2_000_000, "1." * 500_000, "+1(" * 300_000, "x1 " * 300_000):
        pii.mentions_of(text)


def card_texts():
    """Two hundred valid cards in one context, a mistyped one there and one elsewhere."""
    good = [f"visa number 4{i:014d}" for i in range(200)]
    valid = [t + str(d) for t in good for d in range(10) if pii.luhn(re.sub(r"\D", "", t + str(d)))]
    docs = list(enumerate(valid))
    return [*docs, (1000, "visa number 4111111111111112 is mistyped"), (1001, "order 4111111111111112 is no card")]


def test_contexts_find_what_the_patterns_miss(spark):
    frame = spark.createDataFrame(card_texts(), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.pii_report(frame).collect()}
    assert found[1000].spans == "card:12:28" and found[1000].n_card == 0
    assert found[1001].spans == ""
    assert found[1000].base_sha256 == sha("")
    masked = pii.redact(frame).where("doc_id = 1000").first()
    assert masked.text == "visa number [CARD] is mistyped"


@pytest.mark.parametrize("others", [10, 80_000])
def test_support_is_independent_of_other_seeds(spark, others):
    few = [t for _, t in card_texts()[:6]] + ["visa number 4111111111111112 here"]
    rows = [(i, t) for i, t in enumerate(few)] + [(1000 + i, f"mail to user{i}@site{i % 97}.org now") for i in range(others)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.find(frame).where("doc_id = 6").first().spans == "card:12:28"


def identifiers(seed):
    draw = random.Random(seed)
    words = ["mail", "to", "Call", "fax:", "card", "no.", "server", "at", "(id", "x", "é", "=", "b,c"]
    marks = ["a@b.co", "u.v@w-x.org", "u@host", "4111111111111111", "4111111111111112", "411111-1111111", "+1 555 010 9999", "555-010-9999",
             "10.0.0.1", "10.0.0.999", "::1:2:3", "1:2:3:4", "99", "a1", "@", "4111 1111 1111 1111"]
    made = []
    for _ in range(draw.randint(0, 30)):
        made.append(draw.choice(words) if draw.random() < 0.6 else draw.choice(["", "(", "<"]) + draw.choice(marks) + draw.choice(["", ".", ")", ","]))
        made.append(draw.choice([" ", " ", "\n", "  ", "", ", "]))
    return "".join(made)


def test_mentions_and_patterns_against_brute_force(spark):
    texts = [identifiers(i) for i in range(700)]
    for text in texts:
        want = [(s, e, k, n, seed, p) for s, e, kinds, seed, p in plain_mentions(text) for n, k in enumerate(kinds)]
        assert pii.mentions_of(text) == want, text
    frame = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (None, texts[9])], "doc_id long, text string").repartition(3)
    patterns = plain_patterns(texts)
    learned = {(r.pattern, r.kind) for r in pii.learn_patterns(pii.mentions(frame)).collect()}
    assert learned == patterns and len(patterns) > 3
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    more = 0
    for i, text in enumerate(texts):
        spans = plain_all_spans(text, patterns)
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert got[i].base == ",".join(f"{k}:{s}:{e}" for s, e, k in plain_spans(text))
        more += len(spans) - len(plain_spans(text))
    assert more > 20 and pii.find(frame).count() == 702
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert all(clean[i] == plain_masked(t, plain_all_spans(t, patterns)) for i, t in enumerate(texts))


def test_words_before_an_identifier_are_read_whole():
    long = "w" * 5000
    assert pii._contexts(f"two {long} 1", 5005, 0)[0] == f"#{pii.xxhash.xxh3_128_hexdigest(long)}"
    assert pii._contexts(f"{long} mail: a@b.co", 5007, 0)[0] == "mail"
    assert pii._contexts("...  ,", 6, 0) == []


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(6)
    docs = [(i, prose(i, draw.randint(1, 200)), draw.choice("abcdefg")) for i in range(3000)]
    docs += [(9000, "a few words", "tiny"), (9001, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix_report(frame).collect()
    again = mixing.mix_report(frame.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    source = {i: s for i, _, s in docs}
    taken, target, size = {}, {}, {}
    for r in rows:
        assert r.taken <= 2 * r.size
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], size[s] = r.target, r.source_size
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    assert all(target[s] <= 2 * size[s] and abs(taken[s] - target[s]) <= 200 for s in target)
    copies = mixing.mix(frame).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies if r.doc_id < 9000} == {
        r.doc_id: r.taken // r.size for r in rows if r.doc_id < 9000 and r.taken
    }


@pytest.mark.parametrize("copies", [1, 400])
def test_mix_cuts_like_a_sorted_source(spark, copies):
    """The cut against sorting each source as a whole, also where it falls between wholly equal rows."""
    draw = random.Random(copies)
    docs = [(draw.choice([None, i, i // 3]), prose(i % 40, draw.randint(0, 60)) or None, draw.choice("ab")) for i in range(300)]
    docs += [(None, "the same words again and again", s) for s in "abc" for _ in range(copies)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = mixing.mixed(frame).collect()
    goal = {r.row.source: r.target for r in rows}
    want = []
    for s, target in goal.items():
        mine = [(i, t, len((t or "").split())) for i, t, x in docs if x == s]
        total = sum(n for *_, n in mine)
        whole, before = int(target // total), 0
        digest = lambda x: hashlib.md5(x.encode()).hexdigest()
        for i, t, n in sorted(mine, key=lambda r: (digest(f"mix-1:{'' if r[0] is None else r[0]}"), digest(r[1] or ""))):
            need = target - whole * total
            want.append((s, i, t, whole + (need > 0 and before + n / 2 <= need)))
            before += n
    assert sorted(map(str, want)) == sorted(str((r.row.source, r.row.doc_id, r.row.text, r.copies)) for r in rows)


def test_cutoffs_move_without_a_step(spark):
    """A group between its language's bounds and its own goes from one to the other as it grows."""
    highs = []
    for n in (1, 20, 50, 51, 199, 200, 3000):
        rows = spark.range(20000 + n).selectExpr(
            "'en' AS lang", f"if(id < {n}, 'new', 'big') AS source", "100L AS n_words", f"if(id < {n}, 40L, 0L) AS n_symbols",
            "0L AS n_dup_lines", "0L AS n_repeat_words", "500L AS word_chars", "false AS base_failed",
        )
        highs.append(quality_rules.cutoffs(rows).where("source = 'new'").first().symbol_rate.high)
    # 400 symbols per 1000 words and a slack of 200: from the language's 200 to the group's own 600.
    own = [200 + 400 * n // (n + quality_rules.PRIOR_ROWS) for n in (1, 20, 50, 51, 199, 200, 3000)]
    assert all(abs(high - want) <= 15 for high, want in zip(highs, own))


def test_held_out_quality_and_language(spark):
    folder = "/root/testdata/sf0.01"
    prepared(spark)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.93 * len(scored)
    named = language_id.languages_of(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in named) >= 0.98 * len(named)


def test_flat_trees_equal_walked_trees():
    import numpy as np

    draw = np.random.default_rng(0)
    x = draw.normal(size=(800, 5))
    forest = quality_model.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float))
    for row, got in zip(x[:50], forest.score(x[:50])):
        margin = forest.base
        for t in range(len(forest.feature)):
            at = 0
            for _ in range(quality_model.DEPTH):
                at = 2 * at + (2 if row[forest.feature[t, at]] > forest.threshold[t, at] else 1)
            margin += forest.leaf[t, at - (2**quality_model.DEPTH - 1)]
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-9
    assert ((forest.score(x) > 0.5) == (x[:, 0] * x[:, 1] + x[:, 2] > 0)).mean() > 0.9


def test_language_of_odd_texts(odd):
    got = {r.doc_id: r for r in language_id.languages_of(odd).collect() if r.doc_id in (1, 2, 3, 4)}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[4].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())


def test_bundles_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    texts = [prose(1, 50), "Ünder 漢字, 12 and", None, "", "!!"]
    whole = language_id.Profiles().bundles(texts)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert np.array_equal(whole, language_id.Profiles().bundles(texts))
    assert not whole[2:].any() and whole[:2].any(axis=1).all()
    # Bound by hand: the three-letter text has the trigrams " ab" and "ab ".
    p = language_id.Profiles()
    v = lambda gram: np.prod([np.roll(p.letter(ord(c)), 2 - j) for j, c in enumerate(gram)], axis=0)
    assert np.array_equal(p.bundles(["Ab"])[0], v(" ab") + v("ab "))


def test_licenses_despite_holder_spelling_and_wrapping(spark):
    known = dict(r for r in licenses.known_licenses(spark).collect())
    mit = known["MIT"] if len(known["MIT"]) > 100 else next(
        r.text for r in licenses.known_licenses(spark).collect() if r.license_id == "MIT" and len(r.text) > 100
    )
    changed = mit.replace("<year> <copyright holders>", "2021 Jane Doe & Co.").replace("License", "LICENCE").replace('"', "'")
    wrapped = "\r\n".join(" ".join(p.split()[i : i + 9]) for p in changed.split("\n") for i in range(0, max(len(p.split()), 1), 9))
    docs = [(1, changed), (2, wrapped.replace("2021 Jane", "1999 Jane")), (3, changed + " extra"), (4, "Text\nreleased under the mit licence\nmore"), (5, None)]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(
        spark.createDataFrame(docs, "doc_id long, text string"), licenses.known_licenses(spark)
    ).collect()}
    assert got[1][0] == "MIT" and got[2][0] == "MIT"
    assert got[3][0] is None and got[4] == (None, "MIT") and got[5] == (None, "")


def plain_merge(word, ranks):
    """Byte pairs by the definition: the lowest rank, the leftmost of equals, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def untrained_ranks(seed):
    """Tokens whose ranks don't follow any order of training, so that a merge can make a pair of lower rank."""
    draw = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)} | {bytes(draw.choice(b"ab") for _ in range(draw.randint(2, 6))) for _ in range(60)}
    order = sorted(tokens)
    draw.shuffle(order)
    return {token: rank for rank, token in enumerate(order)}


@pytest.mark.parametrize("seed", range(12))
def test_merging_follows_the_definition(seed):
    draw = random.Random(seed)
    vocabulary = bpe.Vocabulary(untrained_ranks(seed), ".+")
    words = [bytes(draw.choice(b"aabbc") for _ in range(draw.randint(1, 150))) for _ in range(200)] + [b"\x00\xff", b"", b"a"]
    got = bpe.merge_words(words, vocabulary.ranks, vocabulary.pairs())
    assert [ids.tolist() for ids in got] == [plain_merge(word, vocabulary.ranks) for word in words]
    assert all(bpe.merge_long(w, vocabulary.ranks) == plain_merge(w, {k: r for k, r in vocabulary.ranks.items() if k != w}) for w in words if w not in vocabulary.ranks)


def test_merging_agrees_with_the_library(vocabulary):
    coder = tiktoken.Encoding("words", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    draw = random.Random(3)
    words = [prose(i, 1) for i in range(300)] + ["".join(chr(draw.choice([97, 233, 0x4E2D, 0x1F600])) for _ in range(n)) for n in range(1, 90)]
    got = bpe.merge_words([w.encode() for w in words], vocabulary.ranks, vocabulary.pairs())
    for word, ids in zip(words, got):
        if len(regex.findall(vocabulary.pattern, word)) == 1:
            assert ids.tolist() == coder.encode_ordinary(word)


def test_texts_are_cut_only_where_the_pattern_cuts(vocabulary):
    assert vocabulary.space_starts_word and not bpe.Vocabulary({}, r"\S+|\s+").space_starts_word
    draw = random.Random(4)
    white = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　"
    for _ in range(3000):
        text = "".join(draw.choice([" ", " ", draw.choice(white), "a", "b", "9", "'", "s", "é", "!", "中"]) for _ in range(draw.randint(0, 14)))
        first, *rest = bpe._pieces(text)
        pieces = [first, *(" " + piece for piece in rest)]
        assert "".join(pieces) == text
        assert [w for p in pieces for w in regex.findall(vocabulary.pattern, p)] == regex.findall(vocabulary.pattern, text)


def test_other_patterns_see_whole_texts(spark, vocabulary):
    docs = spark.createDataFrame([(1, "one  two three"), (2, ""), (3, None)], "doc_id long, text string")
    other = bpe.Vocabulary(vocabulary.ranks, r"\S+\s\S+|\s+|\S+")
    coder = tiktoken.Encoding("words", pat_str=other.pattern, mergeable_ranks=other.ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, other).collect()}
    assert got == {1: coder.encode_ordinary("one  two three"), 2: [], 3: []}


def test_ids_outside_the_vocabulary_have_no_bytes(spark, vocabulary):
    rows = [(1, [-1, 0]), (2, [0, 10**9]), (3, [0, 1]), (4, []), (5, None), (6, [0, None])]
    decoded = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), vocabulary).collect()
    by_rank = {rank: token for token, rank in vocabulary.ranks.items()}
    assert {r.doc_id: r.decoded for r in decoded} == {1: None, 2: None, 3: by_rank[0] + by_rank[1], 4: b"", 5: None, 6: None}


def test_round_trip_leaves_no_table_behind(spark, vocabulary, odd):
    before = {t.name for t in spark.catalog.listTables()}
    both = bpe.round_trip(odd, vocabulary)
    rows = both.collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert len(rows) == odd.count() and all(bytes(r.decoded) == bytes(r.decoded) for r in rows)
    again = bpe.decode(both.select("doc_id", "ids"), vocabulary)
    assert sorted(map(str, again.select("doc_id", "decoded").collect())) == sorted(map(str, both.select("doc_id", "decoded").collect()))


def disguised(text, seed):
    """The same licence under another holder, wrapping, case, punctuation and spelling."""
    draw = random.Random(seed)
    for spelling, usual in licenses.SPELLINGS[:2] + licenses.SPELLINGS[4:7]:
        text = text.replace(usual, spelling) if draw.random() < 0.5 else text.replace(spelling, usual)
    own = re.compile(r"(?i)\s*(copyright|\(c\)|©).*(\d{4}|<year>|\(c\)|©)|\s*all rights reserved\.?\s*$")
    body = [line for line in text.split("\n") if not own.match(line)]
    words = " ".join(body).replace('"', draw.choice(["'", "“", '"'])).split()
    width = draw.randint(4, 20)
    lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
    held = f"Copyright (c) {draw.randint(1990, 2025)} Holder {draw.randint(1, 999)}, Inc."
    made = draw.choice(["\n", "\r\n", "  \n\t"]).join([held, "All rights reserved.", *lines])
    return made.upper() if draw.random() < 0.2 else made


def test_recall_of_planted_whole_licenses(spark):
    known = licenses.known_licenses(spark).where("length(text) > 200")
    texts = {r.license_id: r.text for r in known.collect()}
    planted = [(name, disguised(text, seed)) for name, text in texts.items() for seed in range(6)]
    docs = [(i, text) for i, (_, text) in enumerate(planted)]
    docs += [(10_000 + i, text[: len(text) // 2]) for i, (_, text) in enumerate(planted)]
    docs += [(20_000 + i, text.replace("software", "hardware", 3) + " no licence") for i, (_, text) in enumerate(planted)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(frame, licenses.known_licenses(spark)).collect()}
    hits = sum(got[i] == name for i, (name, _) in enumerate(planted))
    assert len(texts) >= 18 and hits >= 0.9 * len(planted)
    assert all(found is None for i, found in got.items() if i >= 10_000)


def test_a_form_is_computed_once_and_lines_are_not_shuffled(spark, odd):
    before = spark.sparkContext.getConf().get("spark.sql.autoBroadcastJoinThreshold", None)
    plans = []
    stored = licenses.stored

    def watch(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    licenses.stored = watch
    try:
        licenses.scan(odd, licenses.known_licenses(spark)).count()
    finally:
        licenses.stored = stored
    plan = dict(plans)["found"]
    assert before is None and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # One generator makes the form; what follows refers to it.
    assert plan.count("translate(") == 1
