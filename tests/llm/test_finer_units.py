"""Words before marks and line feeds are encoded once, alike in every place."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from inkledger.llm import alignment, queries
from inkledger.llm.common import WordEncoder

TEXTS = [
    "word, word. word\nword!\nWord", "a\n\nb,\n c ,\nd", "don't, x's. we'll;'s", "a.,b ..c &&&\n", "x,́y n;̸", "1,2.3 é, ñ.\né", "<|endoftext|>, <|endoftext|", "\n,a", "a,", "tail.\n", "A.\n b,\tc\r\n,d\x01,e", ",", "",
]


def test_units_end_before_marks_and_feeds():
    both = alignment.Encoders(*queries.ALIGNED)
    known, index, _ = both.units([b"word word, word.\nword"])
    assert len(index) == 7 and len(known) == 5
    texts = [t for t in TEXTS if t]
    known, index, bounds = both.units([t.encode() for t in texts])
    for k, t in enumerate(texts):
        own = [known[j] for j in index[bounds[k] : bounds[k + 1]]]
        for which in (0, 1):
            want = both._ids(which, [" " + t])[0]
            if not own:
                assert any(both._joined(w, both._ids(w, [" " + t])[0]) != (" " + t).encode() for w in (0, 1)), t
            else:
                assert np.frombuffer(b"".join(u[which] for u in own), dtype=np.int32).tolist() == want.tolist(), t


def test_words_end_before_marks():
    encoder, plain = WordEncoder(queries.TOKENIZER), Tokenizer.from_file(queries.TOKENIZER)
    ids, ends = encoder.encode(pa.array(TEXTS))
    for k, t in enumerate(TEXTS):
        assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert "word" in encoder.young and "word," not in encoder.young
