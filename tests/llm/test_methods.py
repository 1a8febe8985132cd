"""Each operator against a plain version, a library, held-out texts or itself in another way."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import contamination, near, personal, sha, words
from pyspark.sql import functions as F

from prodseries.llm import bpe, decontaminate, fixity, language_id, license_texts, licenses, near_dup, pii, storage, token_rollups, unit_dedup, vector_search

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def by_key(list_):
    return sorted(list_, key=lambda r: tuple((x is not None, x) for x in r))


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_is_that_of_brute_force(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = contamination(texts, [tuple(r) for r in items.collect()])
    assert sum(r[5] for r in want) > 5
    assert rows(decontaminate.report(docs, items), *COLUMNS) == by_key(want)


@pytest.mark.parametrize("most", [50_000, 3])
def test_short_items_and_overlaps(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)  # 3: the joined way
    rng = random.Random(2)
    word = [f"w{i}" for i in range(6)] + ["É", "日本"]
    docs = [(i, " ".join(rng.choice(word) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    items = [(0, "W0 w1"), (1, "w0, W1!"), (2, "..."), (3, None), (None, "w2 w3 w4"), (4, " ".join(docs[3][1].split()[:20])), (5, "w5")]
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.report(d, b), *COLUMNS) == by_key(contamination(docs, items))


def test_removal_of_documents_and_spans(spark):
    d = spark.createDataFrame([(1, "keep a b c this"), (2, "none"), (3, "A b, c")], SCHEMA)
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert rows(decontaminate.removed(d, b), "doc_id") == [(2,)]
    assert rows(decontaminate.spans_removed(d, b), "doc_id", "text") == [(1, "keep this"), (2, "none"), (3, "")]


def test_language_of_held_out_texts(docs):
    found = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 150
    assert found.where("score < 0 OR score > 1").count() == 0
    again = docs.select("doc_id", F.upper("source").alias("source"), "lang", "text").repartition(7)
    assert rows(language_id.languages(again), "doc_id", "lang_pred", "ambiguous") == rows(found, "doc_id", "lang_pred", "ambiguous")


def test_codewords_differ():
    for k in (2, 3, 4, 6, 9, 20):
        code = language_id.codewords(k)
        assert len({tuple(r) for r in code}) == k and (np.abs(code.sum(0, dtype=int)) < k).all()


def test_near_groups_are_those_of_all_pairs(docs, texts):
    want = [(d, n, c, d == c) for d, n, c in near(texts)]
    assert rows(near_dup.groups(docs), "doc_id", "n_shingles", "component_id", "kept") == by_key(want)


@pytest.mark.parametrize("block", [2048, 8])
def test_large_groups_chains_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(3)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]
    docs, chain = [], list(base)
    for i in range(60):  # each differs a little from the one before: far ends do not link themselves
        chain = list(chain)
        chain[rng.randrange(200)] = f"x{i}"
        docs.append((1000 - i, " ".join(chain)))
    for i in range(60):  # copies with changes of their own, around the limit
        other = list(base)
        for k in rng.sample(range(200), rng.randrange(2, 16)):
            other[k] = f"y{i}-{k}"
        docs.append((2000 + i, " ".join(other)))
    docs += [(3000 + i, "one two") for i in range(30)] + [(4000, "One  TWO"), (4001, "one two three")]
    want = [(d, c) for d, _, c in near(docs)]
    assert rows(near_dup.groups(spark.createDataFrame(docs, SCHEMA)), "doc_id", "component_id") == by_key(want)


def test_signature_shares_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
        x, y = (np.frombuffer(near_dup.bands(np.unique(s))[1], dtype=np.uint8) for s in (a, b))
        errors.append((x == y).mean() - 300 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_personal_data_is_that_of_brute_force(spark, texts):
    rng = random.Random(5)
    some = ["a", "b@", ".", "@", "c.d", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+1 (", "555", "-", " ", "é",
            "😀", "\n", "10.0.0.1", "256.1.1.1", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "card", "_", "%"]
    made = [(10**6 + i, "".join(rng.choice(some) for _ in range(rng.randrange(1, 25)))) for i in range(800)]
    made += [(-1, "\U0010FFFFa@b.cc\U0010FFFF x@y.zz"), (-2, "1" * 30_000), (-3, "a" * 30_000), (-4, "1 " * 15_000), (-5, "+(" * 9_000)]
    made += [(-6, "a@b" + ".c" * 9_000), (-7, "x@y.zz " * 700), (-8, "+1(((((" * 3_000)]
    docs = texts + made
    want = []
    for doc, text in docs:
        found = personal(text)
        listed = ",".join(f"{k}:{a}:{b}" for k in found for a, b in found[k])
        want.append((doc, *map(len, found.values()), sha(listed)))
    got = pii.report(spark.createDataFrame(docs, SCHEMA))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == by_key(want)
    assert got.where("n_iban > 0").count() > 50


def test_context_and_checksums(spark):
    docs = [(1, "IBAN: GB82 WEST 1234 5698 7654 32"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "my card 4111 1111 1111 1111"), (4, "4111 1111 1111 1112")]
    got = {r.doc_id: (r.n_iban, r.n_card, round(r.top_score, 2)) for r in pii.report(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: (1, 0, 1.0), 2: (0, 0, 0.0), 3: (0, 1, 0.8), 4: (0, 0, 0.0)}


def test_ibans_end_where_their_country_says(spark):
    def made(code, rest):
        return f"{code}{98 - int(''.join(str(int(c, 36)) for c in rest + code + '00')) % 97:02}{rest}"

    some = ["ES9121000418450200051332", "AT611904300234573201", "BE68539007547034", "PL61109010140000071219812874", "GB82WEST12345698765432",
            "NO9386011117947", "SE4550000000058398257466", made("ZZ", "1234567890123456"), made("FR", "20041010050500013M02606"), made("RU", "0" * 29)]
    apart = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in some]
    after = ["", " Please pay", " Total", " BIC CODE", " 2024", " A", " ABCD EFGH", ".", ", x"]
    docs = [(i, f"to {x}{y}", x) for i, (x, y) in enumerate((x, y) for x in some + apart for y in after)]
    docs += [(1000, f"{apart[0]} {apart[1]}", None), (1001, f"x{some[0]} {some[1]}y {apart[2]}7", None), (1002, "AB12 " * 2_000 + "AB12CDEF" * 9_000, None)]
    frame = spark.createDataFrame([d[:2] for d in docs], SCHEMA)
    want = {i: f"iban:3:{3 + len(x)}" for i, _, x in docs if x} | {1000: f"iban:0:{len(apart[0])},iban:{len(apart[0]) + 1}:{len(apart[0]) + len(apart[1]) + 1}"}
    got = {r.doc_id: r.spans for r in pii.report(frame).collect()}
    got = {i: ",".join(x for x in v.split(",") if "iban" in x) for i, v in got.items()}
    assert {i: got[i] for i in want} == want and got[1001] == ""
    assert pii.redacted(frame).where("doc_id = 1").first().text == "to [IBAN] Please pay"


def test_redaction(spark):
    docs = [(1, "a@b.cc und +49 (30) 1234567é", 5), (2, "nothing", 7), (3, None, None)]
    got = rows(pii.redacted(spark.createDataFrame(docs, SCHEMA + ", n_chars int")), "doc_id", "text", "n_chars")
    assert got == [(1, "[EMAIL] und [PHONE]é", 20), (2, "nothing", 7), (3, None, None)]


def test_bpe_is_that_of_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    docs = texts[:300] + [(-1, "x<|endoftext|>  hi\n\n <|endoftext"), (-2, "a" * 50_000), (-3, "".join(map(chr, range(1, 0x3000, 7))))]
    codec = bpe.Codec(open(bpe.default_path(), encoding="utf-8").read())
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r.doc_id: r for r in bpe.round_trip(df).join(bpe.digests(df), "doc_id").collect()}
    for doc, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[doc].ids == ids and got[doc].text == decoded == text
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(20)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert rows(bpe.decode(bpe.encode(df)), "doc_id", "text") == by_key(docs)


def test_language_counts_and_decoding_against_plain_ones(spark):
    """n-grams counted one by one, and codewords compared one by one."""
    from collections import Counter

    rng, m32 = random.Random(9), 2**32 - 1
    said = [("a", "Ab, c"), ("b", "Łódź é"), ("a", ""), ("b", "  x "), ("c", "abab 12")]
    said += [(rng.choice("abc"), "".join(rng.choice("aBcé ź.日") for _ in range(rng.randrange(60)))) for _ in range(40)]
    want = Counter()
    for lang, text in said:
        code = [0x20 if b < 128 and not chr(b).isalpha() else b | 0x20 if b < 128 else b for b in text.lower().encode()]
        for n in language_id.GRAMS:
            for i in range(len(code) - n + 1):
                if code[i] == 0x20 == code[i + n - 1]:
                    continue
                mixed = sum(c * int(language_id.MULTIPLIERS[k]) for k, c in enumerate(code[i : i + n])) & m32
                hashed = ((mixed ^ mixed >> 15) * 0x2C1B3C6D + (n * 0x632BE5AB & m32)) & m32
                want[lang, (hashed ^ hashed >> 13) & (language_id.BUCKETS - 1)] += 1
    got = language_id._counts(spark.createDataFrame(said, "lang string, text string"), ["a", "b", "c"])
    assert {("abc"[i], int(b)): int(got[i, b]) for i, b in zip(*np.nonzero(got))} == dict(want)
    code = language_id.codewords(5)
    trust = np.random.default_rng(1).random(code.shape) + 0.5
    model = language_id.Model(tuple("abcde"), code, np.zeros((code.shape[1], language_id.BUCKETS)), trust)
    answers = np.random.default_rng(2).uniform(-1, 1, (50, code.shape[1]))
    at, score, ambiguous = model.decode(answers)
    for i, row in enumerate(answers):
        loss = [sum(math.exp(-x * int(code[k, j])) * trust[k, j] for j, x in enumerate(row)) for k in range(5)]
        best = min(range(5), key=lambda k: loss[k])
        first, second = sorted(loss)[:2]
        assert at[i] == best and bool(ambiguous[i]) == (first >= language_id.AMBIGUOUS * second)
        assert abs(score[i] - 1 / sum(math.exp(-4 * (x - first)) for x in loss)) < 1e-9


def variants(template, fill, keep):
    """The words of a template with its optional parts kept or not, and each replaceable region filled by fill(max)."""
    out, skip = [], 0
    for i, part in enumerate(licenses.MARKUP.split(template)):
        if i % 2 == 0:
            out += [] if skip else [w.decode() for w in licenses.words(part)]
        elif part == "beginOptional":
            skip += not keep or skip > 0
        elif part == "endOptional":
            skip -= skip > 0
        elif not skip:
            out += fill(int(part.split("max=")[1]))
    return out


def plain_end(parts, tokens, at):
    """The longest end of a match of nested parts (word, ("opt", parts), ("any", n)) from `at` on, by trying everything."""
    if not parts:
        return at
    first, rest, ends = parts[0], parts[1:], []
    if isinstance(first, str):
        return plain_end(rest, tokens, at + 1) if at < len(tokens) and tokens[at] == first else None
    if first[0] == "opt":
        ends = [plain_end(rest, tokens, at), plain_end([*first[1], *rest], tokens, at)]
    else:
        ends = [plain_end(rest, tokens, at + n) for n in range(first[1] + 1) if at + n <= len(tokens)]
    return max((e for e in ends if e is not None), default=None)


def plain_parts(template):
    stack = [[]]
    for i, part in enumerate(licenses.MARKUP.split(template)):
        if i % 2 == 0:
            stack[-1] += [w.decode() for w in licenses.words(part)]
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            done = stack.pop()
            stack[-1].append(("opt", done))
        else:
            stack[-1].append(("any", int(part.split("max=")[1])))
    return stack[0]


def labels_of(tokens, of):
    return {a.label for a, _, _ in licenses.scan(" ".join(tokens), of)[1]}


@pytest.mark.parametrize("at", range(len(license_texts.templates()) - len(license_texts.SPDX) - 5))
def test_a_license_is_its_whole_wording(at):
    label, template = license_texts.templates()[at]
    of = licenses.automata()
    for keep in (True, False):
        for fill in (lambda n: [], lambda n: ["x1"], lambda n: [f"x{i}" for i in range(n)]):
            text = ["before", *variants(template, fill, keep), "after"]
            assert label in labels_of(text, of)
    bare = variants(template, lambda n: [], False)
    for k in sorted({0, 1, len(bare) // 3, len(bare) // 2, len(bare) - 1}):
        assert label not in labels_of([*bare[:k], "changed", *bare[k + 1 :]], of)  # a mandatory word changed
        assert label not in labels_of(bare[:k] + bare[k + 1 :], of) or k == len(bare) - 1 and label.startswith("cc")
    if len(bare) > 40:
        assert label not in labels_of([*bare[:20], "and", "not", "for", "evil", *bare[20:]], of)  # a clause added


def test_spdx_lines():
    of = licenses.automata()
    for name in license_texts.SPDX:
        assert name in labels_of([f"// SPDX-License-Identifier: {name.upper()}"], of)


def test_matching_against_a_plain_matcher():
    rng = random.Random(11)
    made = ["a b <<beginOptional>>c <<beginOptional>>d<<endOptional>> e<<endOptional>> <<var;name=x;max=2>> f",
            "<<beginOptional>>a<<endOptional>> b <<var;name=x;max=1>> <<var;name=y;max=3>> c", "c a <<var;name=x;max=2>>", "b b b"]
    of = [licenses.compiled(str(i), t) for i, t in enumerate(made)]
    parts = [plain_parts(t) for t in made]
    hits = 0
    for _ in range(400):
        tokens = [rng.choice("abcdef") for _ in range(rng.randrange(0, 30))]
        want = {(i, s, e) for i, p in enumerate(parts) for s in range(len(tokens)) if (e := plain_end(p, tokens, s)) is not None and e > s}
        got = {(int(a.label), s, e) for a, s, e in licenses.scan(" ".join(tokens), of)[1]}
        assert got == want
        hits += len(want)
    assert hits > 100


def test_scan_of_documents_against_a_plain_matcher(docs, texts):
    plain = [(label, plain_parts(t), t) for label, t in [*((v, k) for k, v in licenses.PHRASES.items()), *license_texts.templates()]]
    want = set()
    for doc, text in texts:
        tokens = words(text)
        places = {}
        for i, w in enumerate(tokens):
            places.setdefault(w, []).append(i)
        for label, parts, template in plain:
            starts = {parts[0]} if isinstance(parts[0], str) else {parts[0][1][0], next(p for p in parts if isinstance(p, str))}
            for s in sorted(i for w in starts for i in places.get(w, ())):
                if (e := plain_end(parts, tokens, s)) is not None:
                    want.add((doc, label, s, e))
    assert len(want) > 5
    assert {tuple(r) for r in licenses.matches(docs).select("doc_id", "label", "start", "end").collect()} == want


def test_license_base_places(docs, texts):
    want = []
    for doc, text in texts:
        w = words(text)
        found = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        starts = [i for i, _ in found]
        want.append((doc, len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    assert sum(r[2] for r in want) > 5
    assert rows(licenses.report(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == by_key(want)


def test_template_regions():
    a = licenses.compiled("x", "grant <<beginOptional>>(the <<var;name=n;max=2>> work)<<endOptional>> to <<var;name=who;max=3>> free")
    for text, fine in {
        "Grant to you free": True, "grant, the big red work to a b c FREE": True, "grant the work to free": True,
        "grant to a b c d free": False, "grant the big old red work to x free": False, "grant work to x free": False, "grants to x free": False,
    }.items():
        assert bool(licenses.scan(text, [a])[1]) == fine, text
    with pytest.raises(ValueError):
        licenses.compiled("x", "<<var;name=n;max=2>> work")


def test_mit_text_with_and_without_its_options():
    template = dict(license_texts.WHOLE)["mit"]
    full = licenses.MARKUP.sub(" ", template)
    assert {a.label for a, _, _ in licenses.scan(full, licenses.automata())[1]} == {"mit"}
    assert not licenses.scan(full.replace("without restriction", "with restriction"), licenses.automata())[1]


def test_units_removed_once(spark):
    line, short = "one two three four five six seven eight", "a b c"
    docs = [(5, f"x\n{line.upper()}!\n{short}"), (3, f"{line}\n{short}"), (9, f"Zz. {line}. Yy\n{line}")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = unit_dedup.removed(df)
    assert rows(got, "doc_id", "start", "end", "kept_doc_id", "kept_start", "n_copies") == [(5, 2, 42, 3, 0, 4), (9, 4, 44, 3, 0, 4), (9, 48, 87, 3, 0, 4)]
    assert rows(unit_dedup.cleaned(df, unit_dedup.ENDS), "doc_id", "text") == [(3, docs[1][1]), (5, f"x\n\n{short}"), (9, "Zz.  Yy\n")]
    assert rows(unit_dedup.cleaned(df), "doc_id", "text") == [(3, docs[1][1]), (5, "x\n\n"), (9, "Zz.  Yy\n")]


def test_units_against_brute_force(docs, texts):
    import re

    first, want = {}, set()
    for doc, text in sorted(texts):
        at = 0
        for stop, after in [*(m.span() for m in re.finditer(unit_dedup.ENDS, text)), (len(text), 0)]:
            key = tuple(words(text[at:stop].lower()))
            if len(key) >= unit_dedup.LEAST_WORDS:
                if key in first:
                    want.add((doc, at, stop, *first[key]))
                first.setdefault(key, (doc, at))
            at = after
    assert len(want) > 100
    assert rows(unit_dedup.removed(docs), "doc_id", "start", "end", "kept_doc_id", "kept_start") == by_key(want)


def test_short_lines_and_texts_without_blanks_repeat(spark):
    chinese, thai = "这是一个没有空格的句子用来测试重复。", "ประโยคนี้ไม่มีช่องว่างและซ้ำกัน"
    docs = [(1, f"Menu\n-----\n{chinese}{chinese[::-1][1:]}。\n{thai}"), (2, f"MENU\n\n{thai}\nother"), (3, f"menu!\n----- \n前面。{chinese}后面的文字")]
    got = rows(unit_dedup.repeats(spark.createDataFrame(docs, SCHEMA)), "doc_id", "start", "end", "kept_doc_id", "kept_start", "n_copies")
    n = len(chinese)
    assert got == [(2, 0, 4, 1, 0, 3), (2, 6, 6 + len(thai), 1, 12 + 2 * n, 2), (3, 0, 5, 1, 0, 3), (3, 6, 12, 1, 5, 2), (3, 16, 16 + n, 1, 11, 2)]


def lines_and_sentences(text):
    """(start, end, unit, key) by plain splitting."""
    import re

    out, at = [], 0
    for line in text.split("\n"):
        pieces, start = [], 0
        for m in [*re.finditer(r"(?<=[.!?])[ \t\r]+|(?<=[。！？｡।॥؟۔])[ \t\r]*", line), None]:
            stop = m.start() if m else len(line)
            if line[start:stop].strip():
                pieces.append((at + start, at + stop, "sentence"))
            start = m.end() if m else stop
        if pieces:
            out.append((at, at + len(line), "line"))
        if len(pieces) > 1:
            out += [p for p in pieces if p[1] - p[0] >= unit_dedup.LEAST_CHARS]
        at += len(line) + 1
    marks = str.maketrans({c: " " for c in unit_dedup.MARKS})
    return [(a, b, u, tuple(words(text[a:b].lower().translate(marks))) or text[a:b].strip()) for a, b, u in out]


def repeated(docs):
    """The lines and sentences of (doc_id, text) that an earlier place has, with that place and the number of places."""
    from collections import Counter

    first, found, count = {}, [], Counter()
    for doc, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        for a, b, unit, key in sorted(lines_and_sentences(text), key=lambda x: x[:2]):
            count[key] += 1
            first.setdefault(key, (doc, a, b))
            if first[key][0] != doc or a >= first[key][2]:
                found.append((doc, a, b, unit, *first[key][:2], key))
    return [(*r[:-1], count[r[-1]]) for r in found]


def test_lines_and_sentences_against_brute_force(docs, texts):
    want = repeated(texts)
    got = unit_dedup.repeats(docs).where("unit <> 'window'")
    assert len(want) > 1000 and {r[3] for r in want} == {"line", "sentence"}
    assert rows(got, "doc_id", "start", "end", "unit", "kept_doc_id", "kept_start", "n_copies") == by_key(want)


def test_odd_lines_and_sentences(spark):
    rng = random.Random(8)
    part = ["Ein Satz mit Wörtern.", "  ", "\t", "--", "İstanbul ŞEHRİ ve daha fazlası!", "menu", "これは長い文章の例であり繰り返し。", "ok?", "a.b.c ", "\u2003", "x" * 40, "...", "…"]
    docs = [(i, "".join(rng.choice([*part, "\n", "\n\n", " ", ". "]) for _ in range(rng.randrange(0, 25)))) for i in range(300)]
    got = unit_dedup.repeats(spark.createDataFrame(docs, SCHEMA)).where("unit <> 'window'")
    want = [r for r in repeated(docs)]
    assert rows(got, "doc_id", "start", "end", "unit", "kept_doc_id", "kept_start", "n_copies") == by_key(want)


def test_cleaned_cuts_what_is_reported(docs, texts):
    spans = {}
    for r in unit_dedup.repeats(docs).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    got = {r.doc_id: r.text for r in unit_dedup.cleaned(docs).collect()}
    assert got == {d: "".join(c for i, c in enumerate(t) if i not in spans.get(d, ())) for d, t in texts}
    assert sum(map(len, got.values())) < 0.9 * sum(len(t) for _, t in texts)


def test_passages_inside_sentences_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    some = lambda n: " ".join(word() for _ in range(n))
    shared, han = some(80), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(160))
    docs = [(1, f"{some(20)} {shared} {some(9)}"), (2, f"é{some(7)}, {shared.upper().replace(' ', '.###', 9)} {some(30)}")]
    docs += [(3, f"{han}{some(3)}"), (4, f"ab{han[:150]}cd"), (5, "na " * 100)]
    got = unit_dedup.repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    cover = {d: set() for d in range(1, 6)}
    for r in got:
        cover[r.doc_id] |= {*range(r.start, r.end)}
        assert r.kept_doc_id == {2: 1, 4: 3, 5: 5}[r.doc_id]
    text = docs[1][1]
    at = text.index(shared[:6].upper())
    lost = unit_dedup.SPREAD - 1
    assert len(cover[2]) >= (80 - 2 * lost) * 7 and min(cover[2]) >= at
    assert text[min(cover[2]) : max(cover[2]) + 1].lower().replace(".###", " ") in shared
    assert len(cover[4]) >= 150 - 2 * lost and cover[4] <= {*range(2, 152)}
    assert {r.unit for r in got} == {"window"} and sum(r.doc_id == 4 for r in got) == 1  # joined to one span
    assert len(cover[5]) and min(cover[5]) >= 3 * unit_dedup.PASSAGE - 1  # the first occurrence stays whole


def test_texts_under_one_id_are_told_apart(spark):
    line, ends = "one two three four five six seven eight", ["first", "second", "third", "fourth"]
    docs = [(i, f"{line}\n{e}") for i, e in zip((1, 1, None, None), ends)]
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows(unit_dedup.removed(df), "doc_id", "start", "end", "n_copies") == [(None, 0, 39, 4)] * 2 + [(1, 0, 39, 4)]
    got = [r.text for r in unit_dedup.cleaned(df).collect()]
    assert sorted(t.split("\n")[1] for t in got) == sorted(ends) and sum(t.startswith(line) for t in got) == 1
    assert sum(t.startswith("\n") for t in got) == 3


def test_search_recall_and_scores(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = {r.vec_id: np.array(r.embedding, dtype=float) for r in e.collect()}
    got = {}
    for r in vector_search.nearest(e).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, v in table.items():
        if q % 50 == 0:
            scores = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), i) for i, w in table.items() if i != q)[:5]
            found = sorted(got[q])
            assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
            assert all(abs(s - (v @ table[i]) / np.sqrt((v @ v) * (table[i] @ table[i]))) < 1e-12 for _, i, s in found)
            hits, total = hits + len({i for _, i in scores} & {i for _, i, _ in found}), total + 5
    assert hits >= 0.9 * total


def test_search_with_equal_vectors_and_few_candidates(spark):
    e = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(12)] + [(50, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = rows(vector_search.nearest(e), "query_id", "rank", "vec_id")
    assert got == [(0, k + 1, k + 1) for k in range(5)] + [(50, k + 1, k) for k in range(5)]
    assert rows(vector_search.nearest(e.where("vec_id IN (0, 3)")), "query_id", "vec_id", "score") == [(0, 3, pytest.approx(1.0))]


def test_search_copies_a_query_once_a_group_of_lists(spark):
    v = np.random.default_rng(1).standard_normal((4000, 16))  # without structure, so that most lists are probed
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    folder = Path(storage.shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("blocks-*"))
    assert vector_search.nearest(e, every=10).count() == 400 * 5
    held = sum(spark.read.parquet(str(f)).select(F.sum(F.size("rows"))).first()[0] for f in set(folder.glob("blocks-*")) - before)
    lists = 4000 // vector_search.PER_LIST
    assert held <= 4000 + 400 * -(-lists // 8)  # not a copy for each list


def test_large_rows_are_stored_in_small_groups(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, bytearray(rng.bytes(1 << 20))) for i in range(40)], "i int, v binary").coalesce(1)
    files = [f.removeprefix("file://") for f in storage.stored(df, "large", storage.LARGE_ROWS).inputFiles()]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in groups) == 40
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 20


@pytest.mark.parametrize("precision", ["f4", "f8"])
def test_scan_of_blocks_against_brute_force(precision):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((900, 64)).astype("f4").astype(float)
    v[300:340] = v[7] * 2.0 ** rng.integers(-2, 3, (40, 1))  # of one direction
    turned, lists = (vector_search.unit(v) @ vector_search.rotation(64)).astype(precision), np.sort(rng.integers(0, 6, 900))
    rows, ids, own = rng.permutation(900), rng.integers(0, 50, 900), np.array([7, 310, 500, 899])
    wanted = [np.array([0, 3]), np.array([0, 1, 2, 3, 4, 5]), np.array([5]), np.array([9])]  # no vector has list 9
    pairs = np.repeat(np.arange(4), [len(w) for w in wanted]), np.concatenate(wanted)
    block = lists, rows, ids, v.astype(precision), np.ascontiguousarray(turned.T)
    at, found, scores = vector_search.meet(block, (pairs, rows[own], v[own], turned[own]), 5)
    for i, q in enumerate(own):
        there = [j for j in range(900) if j != q and lists[j] in wanted[i]]
        score = dict(zip(there, vector_search.cosine(v[there], np.repeat(v[q][None], len(there), 0)))) if there else {}
        best = sorted(there, key=lambda j: (-score[j], ids[j]))[:5]
        assert found[at == i].tolist() == [ids[j] for j in best] and scores[at == i].tolist() == [score[j] for j in best]


INSERTS = "op string, source string, lang string, tokenizer string, n_tokens long"


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_two_writers_that_both_prepared(spark, order):
    first, second = token_rollups.Rollup(spark), None
    second = token_rollups.Rollup(spark, first.folder)
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "t", n)], INSERTS)
    both = [(w, w.prepare(token_rollups.deltas(batch(10)))) for w in (first, second)]
    assert [both[i][0].publish("one", both[i][1]) for i in order] == [True, False]
    assert first.commit("two", batch(5))
    total = [("a", "en", "t", 2, 15)]
    columns = (*token_rollups.KEYS, "n_docs", "n_tokens")
    assert rows(second.totals(), *columns) == total
    # two compactions of the same batches, and one of more of them
    folds = [(w, w.fold()) for w in (first, second)]
    assert first.commit("three", batch(1))
    more = second.fold()
    assert [folds[i][0].publish(*folds[i][1]) for i in order] == [True, False]
    assert not second.publish(*more)
    assert rows(first.totals(), *columns) == [("a", "en", "t", 3, 16)] and len(first.live()) == 2
    assert first.compact() and not first.compact() and not first.commit("one", batch(10))
    assert rows(second.totals(), *columns) == [("a", "en", "t", 3, 16)] and len(first.live()) == 1


def test_rollup_commits_once_and_moves(spark):
    r = token_rollups.Rollup(spark)
    columns = "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long, old_source string"
    first = spark.createDataFrame([("insert", "a", "en", "t1", 10, None, None), ("insert", "a", "en", "t1", 5, None, None), ("insert", None, "en", "t1", None, None, None)], columns)
    second = spark.createDataFrame([("revise", "b", "en", "t1", 7, 5, "a"), ("delete", "a", "en", "t1", 10, None, None)], columns)
    assert r.commit("1", first) and not r.commit("1", first)
    assert rows(r.totals(), *token_rollups.KEYS, "n_docs", "n_tokens") == [(None, "en", "t1", 1, 0), ("a", "en", "t1", 2, 15)]
    assert r.commit("2", second) and not r.commit("2", second)
    want = [(None, "en", "t1", 1, 0), ("b", "en", "t1", 1, 7)]
    assert rows(r.totals(), *token_rollups.KEYS, "n_docs", "n_tokens") == want
    r.compact()
    assert rows(r.totals(), *token_rollups.KEYS, "n_docs", "n_tokens") == want and not r.commit("1", first)
    assert not r.publish("1", r.prepare(token_rollups.deltas(first)))  # a second writer that did not see the first
    assert rows(r.totals(), *token_rollups.KEYS, "n_docs", "n_tokens") == want
    assert rows(token_rollups.Rollup(spark, r.folder).totals(), *token_rollups.KEYS, "n_docs", "n_tokens") == want
    with pytest.raises(Exception, match="not an op"):
        r.commit("3", spark.createDataFrame([("add", "a", "en", "t1", 1, None, None)], columns))


def plain_archive(pages, per_file, nameless):
    """[file, offset, record_id, mark, head, html] of each page, by plain sorting."""
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    files = {}
    for page, url, html in pages:
        url, html, name = url or "", html or "", "" if page is None else str(page)
        head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:page:{name}>\r\nContent-Length: {len(html.encode())}\r\n\r\n"
        file = f"none-{int(md5(url + html)[:8], 16) % nameless}" if page is None else f"pages-{page // per_file}"
        files.setdefault(file, []).append((page, sha(f"{head}{html}\r\n\r\n"), md5(f"{url} {name}"), head, html))
    out = []
    for file, rows_ in files.items():
        at = 0
        for page, _, mark, head, html in sorted(rows_, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            out.append((file, at, page, mark, head, html))
            at += len(f"{head}{html}\r\n\r\n".encode())
    return out


def test_replica_hashed_from_its_own_bytes(spark):
    rng = random.Random(6)
    pages = [(rng.randrange(60) if rng.random() < 0.9 else None, f"u{rng.randrange(200)}", rng.choice(["", None, "xé日本" * rng.randrange(30), "h" * 70_000])) for _ in range(400)]
    pages += [pages[3]] * 40
    placed = fixity.layout(spark.createDataFrame(pages, "page_id long, url string, html string"), per_file=20)
    one = plain_archive(pages, 20, -(-sum(p[0] is None for p in pages) // 20))
    ends, two = {}, []
    for file, at, page, mark, head, html in one:
        whole = f"{head}{html}\r\n\r\n"
        ends[file] = max(ends.get(file, 0), at + len(whole.encode()))
        middle = len(head) + len(html) // 2
        if mark[0] in "a7":
            whole = whole[:middle] + ("y" if whole[middle] == "x" else "x") + whole[middle + 1 :]
        if mark[0] != "b":
            two.append((file, at, page, whole[:middle] if mark[0] == "3" else whole))
    two += [(f, at + ends[f], page, f"{head}{html}\r\n\r\nagain") for f, at, page, mark, head, html in one if mark[0] == "c"]
    describe = lambda replica: {(f, at, page): (len(w.encode()), sha(w)) for f, at, page, w in replica}
    a, b = describe((*r[:3], f"{r[4]}{r[5]}\r\n\r\n") for r in one), describe(two)
    columns = "file", "offset", "record_id", "length", "digest"
    assert rows(fixity.index(placed), *columns) == by_key((*k, *v) for k, v in a.items())
    assert rows(fixity.worn(placed), *columns) == by_key((*k, *v) for k, v in b.items())
    kind = lambda k: "missing" if k not in b else "extra" if k not in a else "altered"
    want = [(*k, (a.get(k) or b[k])[0], kind(k)) for k in {**a, **b} if a.get(k) != b.get(k)]
    assert len(want) >= 100 and {w[4] for w in want} == {"missing", "extra", "altered"}
    got = fixity.audit(fixity.index(placed), fixity.worn(placed))
    assert rows(got, "file", "offset", "record_id", "length", "damage") == by_key(want)


def test_a_full_file_is_split(spark, monkeypatch):
    monkeypatch.setattr(fixity, "MOST_PAGES", 50)
    pages = [(7, f"u{i}", "h" * (i % 9)) for i in range(400)] + [(8, "same", "page")] * 300
    got = fixity.records(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 700 and len({r.file for r in got}) == 9
    for file in {r.file for r in got}:
        at = 0
        for r in sorted((r for r in got if r.file == file), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_fixity_descends_to_the_damage(spark, monkeypatch):
    monkeypatch.setattr(fixity, "LEAF", 64)
    rows_ = [(f, k * 10, 10, k, f"d{f}{k}") for f in ("x", "y") for k in range(400)]
    schema = "file string, offset long, length long, record_id long, digest string"
    one = spark.createDataFrame(rows_, schema)
    assert fixity.audit(one, one).count() == 0
    changed = [r for r in rows_ if r[:2] != ("x", 1230)]
    changed = [(*r[:4], "bad") if r[:2] == ("x", 40) else r for r in changed] + [("x", 4001, 10, 900, "new"), ("z", 0, 10, 1, "file")]
    got = fixity.audit(one, spark.createDataFrame(changed, schema))
    assert rows(got, "file", "offset", "record_id", "damage") == [
        ("x", 40, 4, "altered"), ("x", 1230, 123, "missing"), ("x", 4001, 900, "extra"), ("z", 0, 1, "extra"),
    ]
