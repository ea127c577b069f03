import pytest

from tessera.operators import labels as L


def unpack(data: bytes) -> str:
    """Six-bit reader for tests."""
    bits = "".join(f"{b:08b}" for b in data) + "1" * 6
    codes = [int(bits[k : k + 6], 2) for k in range(0, len(bits) - 5, 6)]
    out, shifted = "", False
    for c in codes:
        if shifted:
            out, shifted = out + L.SYMBOLS[c], False
        elif c == L.SYMBOL_SHIFT:
            shifted = True
        elif c >= 0x30:
            break
        else:
            out += " " if c == 0 else chr(c + 64) if c < 27 else chr(c + 16)
    return out


@pytest.mark.parametrize("text,want", [("Rue d'Été 12", "RUE D'ETE 12"), ("A", "A"), ("AB", "AB"), ("ABC", "ABC"), ("ABCD", "ABCD"), ("Œuf @ 5/7", "OEUF @ 5/7"), ("straße", "STRASSE"), ("中x", "X")])
def test_six_bit(text, want):
    assert unpack(L.six_bit(text)) == want


def test_other_forms():
    assert L.encode_label("é€Ł", 9) == b"\xe9\x80?\0"
    assert L.encode_label("é", 10) == b"\xc3\xa9\0"
    assert L.encode_label("", 6) == b"" and L.encode_label(None, 9) is None


def test_lengths(spark):
    rows = [(t,) for t in ("Rue d'Été 12", "Œuf @ 5/7", "straße", "中x", "a-b", "0")]
    df = spark.createDataFrame(rows, "t string")
    for form in (6, 9, 10):
        for r in df.select("t", L.encoded_length(df.t, form).alias("n")).collect():
            assert r.n == len(L.encode_label(r.t, form)), r.t


def test_interned_offsets(spark):
    rows = [(1, 1, "ab"), (1, 2, ""), (1, 3, "xyz"), (1, 4, "ab"), (2, 1, "xyz"), (1, 5, None)]
    df = spark.createDataFrame(rows, "tile int, seq int, label string")
    got = {(r.tile, r.seq): r.label_offset for r in L.interned(df, "label", ["tile"], ["seq"]).collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (1, 3): 3, (1, 4): 1, (2, 1): 1, (1, 5): 0}
    six = {(r.tile, r.seq): r.label_offset for r in L.interned(df, "label", ["tile"], ["seq"], 6).collect()}
    assert six[1, 1] == 1 and six[1, 3] == 1 + len(L.six_bit("ab"))
