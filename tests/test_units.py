"""Published vectors, round trips and refusals of the sequential parts."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkledger import engine
from inkledger.functions import charsets as cs
from inkledger.functions import crypto
from inkledger.operators import codec, wordmark
from inkledger.sources import files, markup

COVER = "Once upon a time there was a small house near the wood, and its people kept a book of letters. " * 12


def test_chacha20_poly1305_vector():
    key, nonce = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    box = crypto.seal(key, nonce, text, bytes.fromhex("50515253c0c1c2c3c4c5c6c7"))
    assert box[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    with pytest.raises(ValueError):
        crypto.unseal(key, box)


def test_ed25519_vector():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert crypto.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert crypto.verify(crypto.public_key(seed), b"", crypto.sign(seed, b""))
    assert not crypto.verify(crypto.public_key(seed), b"x", crypto.sign(seed, b""))


def test_checksums():
    assert codec.crc16(b"123456789") == 0x29B1
    assert zlib.crc32(b"123456789") == 0xCBF43926


@given(st.binary(min_size=1, max_size=60), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_frame_at_any_bit(payload, shift):
    assert codec.scan("0" * shift + codec.to_bits(codec.frame(payload, salt=b"s" * 16)))[1:] == (b"s" * 16, payload)


@given(st.lists(st.tuples(st.text(max_size=9), st.binary(max_size=200))), st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_envelope(chain, payload):
    assert codec.open_envelope(codec.envelope(chain, payload)) == (chain, payload)


def test_frame_refusals():
    with pytest.raises(ValueError, match="empty_payload"):
        codec.frame(b"")
    bits = codec.to_bits(codec.frame(b"x", flags=0x10))
    with pytest.raises(ValueError, match="reserved_flags"):
        codec.unframe(bits)


@pytest.mark.parametrize("carrier", codec.CARRIERS)
def test_carrier_round_trip(carrier):
    marked = codec.encode(COVER, b"hello", (carrier,))
    assert marked != COVER and codec.decode(marked) == (b"hello", [carrier])
    with pytest.raises(ValueError, match="occupied"):
        codec.encode(marked, b"hello", (carrier,))


def test_code_is_left_alone():
    text = COVER + "\n```\na code block with aeo\n```\n" + COVER
    assert "\n```\na code block with aeo\n```\n" in codec.encode(text, b"hi", codec.CARRIERS)


def test_invisible_sets():
    assert [len(x) for x in (cs.FORENSIC, cs.METRICS, cs.CONTROL, cs.PIPELINE, cs.BIDI, cs.JOINERS)] == [24, 17, 22, 22, 11, 6]


def test_importers():
    assert markup.from_html("<h1>T</h1><p>a <b>b</b></p><script>x</script>") == "# T\n\na **b**"
    assert markup.from_csv('a,b\n1,"x,y"') == "| a | b |\n| --- | --- |\n| 1 | x,y |"
    assert markup.from_org("* Head :tag:\ntext") == "# Head\n\ntext"
    assert "```python\nx = 1\n```" in markup.from_ipynb('{"cells": [{"cell_type": "code", "source": ["x = 1"]}]}')
    with pytest.raises(ValueError, match="no_notebook"):
        markup.from_ipynb("{}")
    with pytest.raises(ValueError, match="broken_archive"):
        files.text_of(b"PK broken", "docx")
    assert files.decoded("é".encode("utf-16")) == files.decoded("é".encode("cp1252")) == "é"
    assert files.mended("cafÃ©") == "café"


def test_signature_needs_its_key():
    text = " ".join(wordmark.WORDS)
    marked = wordmark.signed(text, b"k")
    assert wordmark.has_signature(marked, b"k") and not wordmark.has_signature(marked, b"other")
    assert wordmark.canonical(marked) == wordmark.canonical(text)


def test_chain_validate():
    assert engine.chain_validate(["homoglyph", "bidi", "bidi"]) == ["bidi", "homoglyph"]
    with pytest.raises(ValueError, match="unknown_carrier"):
        engine.chain_validate(["ink"])


def test_sql_functions(spark):
    engine.register(spark)
    assert spark.sql("SELECT ink_invisible('a​b') AS n, ink_pristine('a​b') AS p").first() == (1, "ab")


def test_cyrillic_prose_is_clean(spark):
    from inkledger.operators import forensic

    docs = spark.createDataFrame([(1, "Это обычный русский текст."), (2, "A pаper with one letter."), (3, "")], "doc_id long, marked string")
    assert {r.doc_id: r.verdict for r in forensic.reported(docs).collect()} == {1: "CLEAN", 2: "CONFIRMED", 3: "CLEAN"}


def test_stream(spark, tmp_path):
    from inkledger.streaming import forensics

    spark.createDataFrame([(1, "plain"), (2, "a​b​c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = forensics.documents(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    done = forensics.verdicts(stream).writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert spark.table("verdicts").count() == 2


def test_recoverable_frame():
    from inkledger.operators import heavy

    bits = heavy.build(2003, b"payload", b"s" * 16, flags=5)
    head, payload = heavy.read(bits + "0" * 3)
    assert payload == b"payload" and head.salt == b"s" * 16 and head.flags == 5
    assert heavy.locate("1" + bits[200:] + "0" * 3)[1] == "tail"
    _, at, _ = heavy.layout(2003)
    assert [n for _, n in heavy.markers(bits[700:])] == [a // heavy.spacing(2003) for a in at if a >= 700]
    with pytest.raises(ValueError, match="too_small"):
        heavy.build(300, b"x")
    with pytest.raises(ValueError, match="bad_checksum"):
        heavy.read("".join("1" if k == 40 and b == "0" else "0" if k == 40 else b for k, b in enumerate(bits)))


def test_claims():
    from inkledger.operators import sealing

    claim = sealing.claim_of("text", bytes(32), [{"kind": "integrity"}])
    assert sealing.claim_findings("text", claim) == []
    assert sealing.claim_findings("text", claim.replace("integrity", "ai_generated")) == ["signature_invalid"]
    assert sealing.claim_findings("text", "{") == ["unreadable_claim"]
    with pytest.raises(ValueError, match="no_assertion"):
        sealing.claim_of("text", bytes(32), [])


def test_metadata_and_pdf():
    png = files._png([(b"IHDR", bytes(13)), (b"tEXt", b"Author\0someone"), (b"IEND", b"")])
    assert files.image_metadata(png) == {"Author": "someone"}
    assert files.image_metadata(files.stripped(png, "png")) == {}
    assert files.credential_presence(b"..jumb..c2pa..") == "present" and files.credential_presence(png) == "absent"
    made = files.pdf("line (one)\n" * 130)
    assert made.startswith(b"%PDF") and made.count(b"/Type /Page ") == 3
