"""Cross-tokenizer alignment against its definition."""

import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF
from inkledger.llm import alignment, queries

ODD = [
    "plain words here", "  two  spaces ", " lead", "tail ", "a\nb\n\nc\td", "é à b 　c", "▁x", "x ▁ y", "日本語 テキスト", "<|endoftext|> x </s> <0x0A> <s>", "\x00\x01 z", "👩‍👩‍👧 ok ́e", "don't I'll we've 's", "===== ---- 12345 1e9", " ", "\n", "a" * 300, "🙂" * 50, "x y z", "\u0085 q   r",
]


def whole_tokens(text):
    """Ids and bytes of both tokenizers' tokens over the whole text, or none."""
    a_path, b_path = queries.ALIGNED
    both = alignment.encoders(a_path, b_path)
    plain = Tokenizer.from_file(a_path)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    if not text:
        return [], [], [], []
    a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    letters = alignment.byte_letters()
    a_bytes = [bytes(letters[c] for c in plain.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    data = (" " + text).encode()
    assert [len(x) for x in a_bytes] == both.sizes[0][a].tolist()
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == data == b"".join(b_bytes) else ([], [], [], [])


def plain_alignment(texts):
    """All results by two pointers over byte ranges."""
    found, counts = [], Counter()
    for text in texts:
        a, a_bytes, b, b_bytes = whole_tokens(text)
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, i, j = [[[], []]], [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            step_a, step_b = a_ends[i] <= b_ends[j], b_ends[j] <= a_ends[i]
            if step_a:
                groups[-1][0].append(a[i])
            if step_b:
                groups[-1][1].append(b[j])
            if step_a and step_b:
                groups.append([[], []])
            i, j = i + step_a, j + step_b
        groups.pop()
        counts.update(links)
        found.append((a, b, groups, links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def test_units_are_encoded_as_in_their_text():
    both = alignment.Encoders(*queries.ALIGNED)
    assert both.apart
    texts = [*ODD, "", "word " * 500 + "x"]
    for part in (texts, texts[::-1]):
        known, index, bounds = both.units([t.encode() for t in part])
        for k, t in enumerate(part):
            want, own = whole_tokens(t), [known[j] for j in index[bounds[k] : bounds[k + 1]]]
            for which in (0, 1):
                assert np.frombuffer(b"".join(u[which] for u in own), dtype=np.int32).tolist() == want[2 * which], t


def test_query_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_alignment(spark, SF).collect()}
    assert len(got) == len(rows)
    for (doc_id, _), want in zip(rows, plain_alignment([t or "" for _, t in rows]), strict=True):
        assert got[doc_id] == want


def test_edges(spark, monkeypatch):
    texts = [*ODD, None, "", ODD[0], ODD[0], "very long " * 30_000]
    docs = spark.createDataFrame([(k if k % 3 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS n_links", "2 AS row", "3 AS pair")
    want = plain_alignment([t or "" for t in texts])
    key = lambda r: (r[0] is None, r[0] or 0, r[-1], r[1])
    for most in (alignment.MOST_PAIRS, 10):
        monkeypatch.setattr(alignment, "MOST_PAIRS", most)
        monkeypatch.setattr(alignment, "FREQUENT", 40 if most == 10 else 1000)
        got = [tuple(r) for r in alignment.cross_aligned(docs, *queries.ALIGNED).collect()]
        assert sorted(got, key=key) == sorted([(k if k % 3 else None, *w) for k, w in enumerate(want)], key=key)
    assert want[ODD.index("▁x")] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.cross_aligned(docs.where("pair = 0"), *queries.ALIGNED).count() == 0
