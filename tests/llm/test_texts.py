"""Operators on single texts against the libraries and plain Python: 1, 7, 8, 9, 10."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import host_quality, packing, pii_votes, suffix_pieces, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SPACES = "[^\x20\x09-\x0d]+"
TEXTS = [
    None, "", " ", "a ", "  a  b ", "a\n b c d", "é à ç", "x <|endoftext|> y<|endoftext|>", "<s> </s>", "it's don't  we'll   b　c d",
    "你 好 a 1 2 33 ", "a " * 500 + "b" * 3000 + " lead", "tab\t x  \n\n y ", "word, word. Word! 12,3", "nul\x00 byte é́ 😀",
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed " * 6, "The same.\nThe same.\n\n\nother\n \nThe same.", "The same.\nThe same.",
    "mail a.b+c@ex-a.org, @x.y a@b c@d.e@f.g now", "1.2.3.4.5 256.1.1.1 0001.2.3.004 10.0.0.1", "card 4917 0852-5696 0696 4917085256960696 1",
    "+1 (677) 555-7033 +49.30.1234567 +12 +1 4961143020124266", "0" * 5000 + ".1.1.1",
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [(i, t, "en", None, None, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, "a ", "en", None, 1, "clash", 7), (None, "No key here", None, None, 1, "clash", 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n_tokens int")
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "'k' as key", "1 as n_tokens")
    return odd.union(more)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def by_row(result):
    return Counter(map(tuple, result))


def test_token_counts(docs, rows):
    model = token_counts.load_model(PIECES)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in rows]
    assert by_row(token_counts.count_tokens(docs, PIECES).collect()) == by_row(want)
    assert by_row(token_counts.count_tokens(docs, PIECES, block_bytes=1000).collect()) == by_row(want)
    assert token_counts.count_tokens(docs.limit(0), PIECES).collect() == []


def test_pieces_match_the_library(docs, rows):
    model = token_counts.load_model(PIECES)
    want = []
    for r in rows:
        ids = np.array(model.encode(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes()), True))
    assert by_row(suffix_pieces.round_trips(docs, PIECES, block_bytes=50_000).collect()) == by_row(want)
    back = suffix_pieces.decode(suffix_pieces.encode(docs, PIECES), PIECES)
    assert by_row(back.collect()) == by_row((r.doc_id, r.text or "") for r in rows)
    assert suffix_pieces.round_trips(docs.limit(0), PIECES).collect() == []


def test_long_runs_and_index_parts(monkeypatch):
    model, own = token_counts.load_model(PIECES), suffix_pieces.Encoder(PIECES)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeinrst▁,éß好"), n)) for n in (*range(1, 40), 60, 300, 900)]
    monkeypatch.setattr(suffix_pieces, "INDEX_CHARS", 100)
    ids, counts = suffix_pieces.encode_segments(own.pieces, ["▁" + w for w in words])
    for word, got in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == model.encode(word)


def check_packing(pieces, rows, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in rows:
        want[(r.doc_id, np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    got, windows = {}, {}
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        got.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    bag = Counter()
    for (doc, _), parts in got.items():
        bag[doc] += sum(len(ids) for _, ids in parts) // 4
    assert bag == Counter({d: n for d in {k[0] for k in want} if (n := sum(len(i) // 4 * c for (k, i), c in want.items() if k == d))})
    for (doc, ids), copies in want.items():
        if copies == 1 and sum(c for (d, _), c in want.items() if d == doc) == 1:
            assert b"".join(x for _, x in sorted(got[doc, len(ids) // 4])) == ids
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(docs, rows, window):
    check_packing(packing.pack(docs, BYTES, window=window, with_ids=True).collect(), rows, window)
    assert packing.pack(docs.limit(0), BYTES).collect() == []


def test_ids_do_not_depend_on_what_the_cache_keeps(monkeypatch):
    """Blocks that overflow the cache again and again: segments met twice stay, the ids are the library's."""
    monkeypatch.setattr(packing, "CACHE_SEGMENTS", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = packing.SegmentIds(path)
    plain = Tokenizer.from_file(path)
    for block in range(12):
        texts = [f"the same words here, number {block} {i} and {i % 3} again" for i in range(8)] + ["", "word" * block]
        ids, ranges = cache.of(pa.array(texts))
        for text, start, stop in zip(texts, ranges[:-1], ranges[1:], strict=True):
            assert ids[start:stop].tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(cache.known) < 200
    assert b" same" in cache.known and b" 0" in cache.known


def test_best_level_is_least_sum_of_squares():
    rng = np.random.default_rng(3)
    for _ in range(200):
        packer = packing.Packer(16)
        packer.levels[1:16] = rng.integers(0, 4, 15)
        length = int(rng.integers(1, 16))

        def cost(level):
            levels = packer.levels.copy()
            if level:
                levels[level] -= 1
            if level + length < 16:
                levels[level + length] += 1
            return int((levels[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 17 - length) if packer.levels[h]]
        assert cost(packer.best_level(length)) == min(map(cost, options))


def quality(text):
    words = re.findall(SPACES, text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += line in seen and bool(re.search(SPACES, line))
        seen.add(line)
    figures = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered))
    return (*figures, len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_figures(docs, rows):
    want = [(r.doc_id, *quality(r.text or "")) for r in rows]
    result = host_quality.judge(docs)
    assert by_row(result.select("doc_id", *host_quality.FIGURES, "base_failed").collect()) == by_row(want)
    assert result.where("base_failed and kept").count() == 0
    empty = host_quality.judge(docs.limit(0))
    assert empty.collect() == [] and host_quality.kept_documents(docs.limit(0)).collect() == []
    kept = host_quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert by_row(kept.select("doc_id", "text").collect()) == by_row(
        (r.doc_id, r.text) for r, w in zip(rows, want, strict=True) if not w[-1])


def test_host_verdicts_shrink(spark):
    good = "word%d " * 40 % tuple(range(40))
    rows = [(i, good if i % 10 else "short", f"h{i % 7}") for i in range(700)]
    rows += [(1000 + i, "short" if i < 95 else good, "bad") for i in range(100)] + [(2000, "short", "tiny"), (2001, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r.doc_id: r for r in host_quality.judge(docs).collect()}
    assert not judged[1099].base_failed and not judged[1099].kept
    assert judged[1].kept and judged[2001].kept and judged[2001].host_rate is None
    assert 0.1 < judged[2000].host_rate < 1
    assert {r.doc_id for r in host_quality.kept_documents(docs).collect()} == {i for i, r in judged.items() if r.kept}


def plain_spans(text):
    found = [(0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c not in " -"]
        total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append((2, m))
    found += [(3, m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_base_spans(docs, rows):
    names = pii_votes.KINDS
    want = {}
    for r in rows:
        spans = plain_spans(r.text or "")
        text = ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans)
        want[r.doc_id] = (*[sum(x[0] == k for x in spans) for k in range(4)], hashlib.sha256(text.encode()).hexdigest(), set(text.split(",")))
    result = pii_votes.digests(pii_votes.find_spans(docs)).collect()
    assert len(result) == len(rows)
    for r in result:
        assert tuple(r)[1:6] == want[r.doc_id][:5]
        assert want[r.doc_id][5] - {""} <= set(r.spans.split(","))
    assert sum(sum(w[:4]) for w in want.values()) > 20
    assert pii_votes.find_spans(docs.limit(0)).collect() == []


def test_added_spans_and_masks(spark):
    rows = [(i, f"Call me, phone +1 (677) 555-{7000 + i} or mail jo{i}@mail.example.com. Card 4917085256960696, host 10.20.30.{i % 250}") for i in range(60)]
    rows += [(100 + i, f"My phone is (677) 555-{7000 + i} ok, e-mail sam{i} (at) example (dot) com please") for i in range(20)]
    rows += [(200, "Nothing of the kind on 12 pages, version 1.2.3.4000"), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii_votes.digests(pii_votes.find_spans(docs)).collect()}
    assert "phone:12:26" in found[100] and "email:" in found[100]
    assert found[200] == found[201] == found[202] == ""
    texts = {r.doc_id: r.text for r in pii_votes.masked(docs).collect()}
    assert texts[5] == "Call me, phone <phone> or mail <email>. Card <card>, host <ip>"
    assert texts[100] == "My phone is <phone> ok, e-mail <email> please"
    assert texts[200] == rows[-3][1] and texts[201] is None and texts[202] == ""


def test_em_trusts_the_reliable_labelers():
    """Votes drawn from known reliabilities: EM finds the classes and the tables again."""
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.6
    right = {1: 0.95, 2: 0.9, 4: 0.5, 5: 0.85}
    codes = np.zeros(len(truth), np.int64)
    for labeler, share in right.items():
        vote = np.where((rng.random(len(truth)) < share) == truth, 1, 2)
        codes += 3**labeler * vote
    every, counts = np.unique(codes + 2 * 4 * 729, return_counts=True)
    p, tables = pii_votes.reliabilities(every, counts.astype(float))
    found = p[np.searchsorted(every, codes + 2 * 4 * 729)] > 0.5
    assert np.mean(found == truth) > 0.93
    for labeler, share in right.items():
        assert abs(tables[1, labeler, 1] - share) < 0.05 and abs(tables[0, labeler, 2] - share) < 0.05
