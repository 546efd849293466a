"""The corpus operators against brute force, exact round trips and held-out labels, with edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("fieldsift.llm.queries")

from fieldsift.llm import ann, byte_bpe, html_text, minhash, packing, quality, suffix_dedup, token_counts, toxicity, url_filter  # noqa: E402
from fieldsift.llm.common import tokenizer_path  # noqa: E402
from fieldsift.llm.queries import URL_RULES  # noqa: E402

SF = "/root/testdata/sf0.001"
PASSAGE = "abcdefghij" * 7
EDGE = [
    (-1, ""), (-2, None), (None, "no id here"), (-3, "  a  b \n\n c▁▁d\t x<s>\r\n {\r y"), (-4, "zz" + PASSAGE[3:60]), (-5, "a" * 300), (-6, "日本語 \x00 é̀ 𝄞𝄞 </s> <0x0A>"),
    (-7, "it's  ' s  x\x1c y 123abc <|endoftext|> z"), (-8, "x" * 5000 + " " * 300), (-9, PASSAGE), (900_001, "q" + "a" * 70 + "é" * 26), (900_002, "Hello  World"), (900_003, "hello world"), (900_004, "é" * 26),
]


@pytest.fixture(scope="module")
def rows(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in own] + EDGE


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_token_counts_match_the_library(rows, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, limit=100).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        n = len(model.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100)


def test_byte_bpe_round_trip_and_ids(rows, docs):
    import tiktoken

    ranks = {piece: rank for rank, piece in enumerate(byte_bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")))}
    same = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()}
    for i, text in rows:
        assert bytes(got[i].ids) == np.array(same.encode_ordinary(text or ""), "<u4").tobytes()
        assert bytes(got[i].decoded) == (text or "").encode()


def test_packing_places_every_id_once(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in rows:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(sum(r.length for r in p) < 1024 for p in by_sequence.values()) <= docs.rdd.getNumPartitions()


@pytest.mark.parametrize("slice_windows", [120_000, 500])
def test_suffix_dedup_is_exact(rows, docs, slice_windows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_WINDOWS", slice_windows)
    got = {r.doc_id: r for r in suffix_dedup.kept_bytes(suffix_dedup.repeated_spans(docs, bucket_bytes=100_000)).collect()}
    first = {}
    for i, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        data = (text or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p : p + 50], i)
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for p in range(len(data) - 49):
                if first[data[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(data), sum(gone), spans)
        assert bytes(got[i].kept) == bytes(x for x, g in zip(data, gone) if not g)


@pytest.mark.parametrize(("words", "percent", "blocks"), [(3, 85, None), (5, 80, 8)])
def test_near_duplicates_are_exact(rows, docs, words, percent, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(minhash, "LIST_BLOCK", 2 * blocks)
        monkeypatch.setattr(minhash, "FAMILY_BLOCK", blocks)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, words, percent).collect()}
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    named = sorted(i for i in sets if i is not None)
    for k, i in enumerate(named):
        for j in named[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    for i in named:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root(i), root(i) == i)
    assert got[None].component_id is None and got[None].kept


def test_ann_recall_and_bad_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    dim = len(table.first().embedding)
    bad = [(90_001, None), (90_002, [0.0] * dim), (90_003, [None] + [1.0] * (dim - 1)), (90_004, [float("nan")] * dim), (90_005, [1.0, 2.0])]
    base = ann.valid_vectors(table.union(spark.createDataFrame(bad, table.schema)))
    held = base.collect()
    assert not {90_001, 90_002, 90_003, 90_004} & {r.vec_id for r in held}
    held = [r for r in held if len(r.vector) == dim]
    ids, v = np.array([r.vec_id for r in held]), np.array([r.vector for r in held])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got = collections.defaultdict(list)
    for r in ann.search(base.where("vec_id % 50 = 0"), base).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    recall = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        score[q] = -9
        top = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        found = sorted(got[ids[q]])
        assert [x[0] for x in found] == list(range(1, len(found) + 1))
        for _, i, s in found:
            assert s == pytest.approx(score[np.flatnonzero(ids == i)[0]], abs=1e-12)
        recall.append(len(top & {i for _, i, _ in found}) / 5)
    assert np.mean(recall) >= 0.9


def test_quality_metrics():
    text = "one two three one two three\n\nsame line\nsame line\n### $$ x\x0by"
    n, chars, symbols, dup, repeats = quality.measure_text(text)[:5]
    assert (n, chars, symbols, dup) == (14, sum(map(len, re.findall("[^\x20\x09-\x0d]+", text))), 5, 1)
    assert repeats == 6
    assert quality.measure_text("")[:5] == (0, 0, 0, 0, 0)


def test_quality_cutoffs_hold_where_junk_is_common(spark):
    words = [f"w{i}" for i in range(200)]
    junk = lambda i: " ".join(w + " ###" for w in words[i % 50 : i % 50 + 60])
    code = lambda i: " ".join([*words[i % 50 : i % 50 + 60], "#" * (20 + i % 3)])
    rows = [(i, junk(i) if i % 20 < 9 else " ".join(words[i % 50 : i % 50 + 60 + i % 7]), "en", "mixed") for i in range(200)]
    rows += [(1000 + i, junk(i) if i % 10 == 0 else code(i), "en", "code") for i in range(200)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: not ((i % 20 < 9) if i < 1000 else (i % 10 == 0)) for i, *_ in rows}


def test_url_rules(spark):
    urls = ["http://A.example.net/en/1", "https://x.net/", "http://x.net", "http://b.example.com/de/x?y#z", "ftp://q.org/fr/1", "no scheme", None, "http://netx/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.decided) for r in url_filter.by_rules(pages, URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("x.net", "/", "net/", "block")
    assert got[2] == ("x.net", "", None, None)
    assert got[3] == ("b.example.com", "/de/x", "example.com/de/", "block")
    assert got[4] == ("q.org", "/fr/1", "org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, None)
    assert got[7][2] is None


def test_toxicity_features_find_obfuscated_words():
    assert toxicity.units("m0r0n!")[0][0] == "moron"
    scanner = toxicity.Scanner({"moron": 5.0})
    assert scanner.features("you m0r0n")[0] == 0.5
    assert scanner.features("")[0] == 0.0


def test_html_text_drops_furniture():
    page = (
        '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><div class="ad">buy</div><article><h1>Head &amp; more</h1>'
        '<p>One<br>two  <b>bold</b></p><div class="comments">first!</div><aside>x</aside></article><footer>&copy; me</footer></body></html>'
    )
    assert html_text.main_text(html_text.page_lines(page), None) == "Head & more One two bold"
    plain = [("logo", False), ("story of a", False), ("imprint", False)]
    other = [("logo", False), ("story of b", False), ("imprint", False)]
    assert html_text.main_text(plain, other) == "story of a"
    assert html_text.main_text(html_text.page_lines(""), None) == ""


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_counts.count_tokens(none).count() == 0
    assert packing.pack(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert quality.judge(none).count() == 0


def test_hash_is_of_kept_bytes():
    assert suffix_dedup.remove_spans(b"abcdef", [1, 3, 5, 6]) == b"ade"
    assert byte_bpe.sha256_hex(b"") == hashlib.sha256(b"").hexdigest()
