"""Operators against brute force over the smallest tables, and their parts against small cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF
from inkledger.llm import fingerprints, html, jaccard, language, packing, queries, sstable, suffixes
from inkledger.llm.common import WordEncoder


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoded(texts):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    return {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}


@given(st.text(max_size=60), st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_prefix_hashes(a, b):
    one, two = fingerprints.Prefixes(a), fingerprints.Prefixes(b)
    common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert one.common_extension(0, two, 0) == common
    assert one.same(0, two, 0, common)
    text, hashes, pair = fingerprints.edited(one, two)
    whole = fingerprints.Prefixes(text)
    assert pair == whole.span(0, whole.n)
    assert set(hashes.tolist()) == set(whole.windows().tolist())


def test_language_held_out(spark):
    got = queries.op3_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_automaton_counts_longest_matches():
    sample = "abcabdabc"
    model = language.Model({"x": sample})
    text = "abdabcc" + "zq" + "bca"
    # Greedy longest matches, an unseen letter being a phrase of its own.
    count, at = 0, 0
    while at < len(text):
        n = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in sample), 0)
        count, at = count + 1, at + max(n, 1)
    assert model.predict([text])[0][3] == count


def test_word_encoder(encoded, texts):
    encoder = WordEncoder(queries.TOKENIZER, max_words=500)
    odd = ["", " ", "a\x01b", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ", "é ́x", "   tab\tfeed\x0b"]
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    for part in (odd, list(texts.values())[:60], odd):
        ids, ends = encoder.encode(part, 1)
        for k, t in enumerate(part):
            assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_sstable_query(spark, encoded):
    got, at = {r.doc_id: r for r in queries.op4_sstable(spark, SF).collect()}, 0
    for i in sorted(encoded):
        ids = encoded[i]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 60000), max_size=20))))
@settings(max_examples=60, deadline=None)
def test_sstable_lookup(entries):
    import io

    entries.sort(key=lambda e: (e[0] is not None, e[0] or 0))
    data = sstable.to_bytes(entries)
    table = sstable.Reader(io.BytesIO(data), len(data))
    assert [(i, ids.tolist()) for i, ids in table] == entries
    for i, _ in entries:
        assert [x.tolist() for x in table.get(i)] == [ids for j, ids in entries if j == i]


def test_suffix_intervals():
    r = random.Random(3)
    for _ in range(80):
        data = np.array([r.randrange(3) for _ in range(r.randrange(4, 40))], dtype=np.int64)
        got = sorted((n, tuple(sorted(s.tolist()))) for n, s in suffixes.maximal_repeats(data, 2, 64))
        places, n = {}, len(data)
        for i in range(n):
            for j in range(i + 2, n + 1):
                places.setdefault(tuple(data[i:j].tolist()), []).append(i)
        want = []
        for k, v in places.items():
            left, right = {data[i - 1] if i else -1 - i for i in v}, {data[i + len(k)] if i + len(k) < n else -9 - i for i in v}
            if len(v) > 1 and len(left) > 1 and len(right) > 1:
                want.append((len(k), tuple(v)))
        assert got == sorted(want)


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_repeats_query(spark, texts, block, monkeypatch):
    import hashlib

    monkeypatch.setattr(suffixes, "BLOCK", block)
    data = {i: t.encode() for i, t in texts.items()}
    seen = Counter(hash(b[k : k + 200]) for b in data.values() for k in range(len(b) - 199))
    for r in queries.op7_repeats(spark, SF).collect():
        b = data[r.doc_id]
        cover = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                cover[k] += 1
                cover[k + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def _sets(texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_jaccard_query(spark, texts, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets, root = _sets(texts), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    for r in queries.op10_jaccard(spark, SF).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), top(r.doc_id))


def test_trie_links():
    r = random.Random(11)
    for _ in range(120):
        base = r.sample(range(90), 40)
        rows = []
        for _ in range(r.randrange(2, 25)):
            row = set(base[: r.randrange(3, 40)])
            for _ in range(r.randrange(4)):
                row.discard(r.randrange(90))
                row.add(r.randrange(120))
            rows.append(np.array(sorted(row), dtype=">u8"))
        sizes = np.array([len(x) + r.randrange(3) for x in rows])

        def joined(pairs, n=len(rows)):
            root = list(range(n))
            for a, b in pairs:
                x, y = root[a], root[b]
                root = [x if z == y else z for z in root]
            return [root.index(z) for z in root]

        want = []
        for a in range(len(rows)):
            for b in range(a):
                both = len(np.intersect1d(rows[a], rows[b]))
                if 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                    want.append((a, b))
        assert joined(jaccard.trie_links(rows, sizes)) == joined(want)


def test_packing_query(spark, encoded):
    got = queries.op9_packing(spark, SF).collect()
    own, room = {}, {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
        room.setdefault(r.sequence_id, []).append(r)
    assert set(own) == set(encoded)
    for i, parts in own.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(encoded[i]), 4096))
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(encoded[i][r.start : r.start + r.length], "<u4").tobytes())
    for parts in room.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(len(e) for e in encoded.values())
    assert len(room) <= -(-total // 4096) + 2


@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 300), max_size=60))
@settings(max_examples=40, deadline=None)
def test_plan_uses_each_length(histogram):
    used = Counter()
    for n, lengths in packing.plan(dict(histogram)):
        assert n > 0 and sum(lengths) <= 4096
        for x in lengths:
            used[x] += n
    assert used == Counter(histogram)


def test_least_squares():
    matrix = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(packing.fitted(matrix, np.array([4.0, 1.0])) @ matrix.T, [4, 1])
    assert packing.fitted(matrix, np.array([-1.0, -1.0])).sum() == 0


def test_html_held_out():
    pages, labels = html.labelled_pages(150, seed=99)
    x, parent, _ = html.features(pages)
    inner = parent != np.arange(len(parent))
    odds = html.default_model().margins(x)
    assert ((odds > 0) == labels)[inner].mean() > 0.98


def test_html_decoding_has_no_contradiction():
    r = np.random.default_rng(4)
    for _ in range(100):
        n = int(r.integers(2, 12))
        parent = np.array([0] + [int(r.integers(0, k)) for k in range(1, n)])
        odds = r.normal(size=n)
        kept = html.decoded(odds, parent)
        assert all(kept[parent[k]] or not kept[k] for k in range(1, n))
        best = max(
            sum(odds[k] for k in range(n) if m >> k & 1) for m in range(1 << n) if all(m >> parent[k] & 1 or not m >> k & 1 for k in range(1, n))
        )
        assert abs(odds[kept].sum() - best) < 1e-9


def test_html_pages(spark):
    import html as entities

    for r in spark.read.parquet(f"{SF}/pages.parquet").join(queries.op5_html(spark, SF), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner))
        assert r.text == "\n".join(b for b in blocks if b)
