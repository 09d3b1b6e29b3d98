from logloom.llm import ppm


def test_contexts_of_five_bytes():
    """The model's contexts are of five bytes; before, of four: what follows "Xbcde" and "Ybcde" was not told apart."""
    grams, _ = ppm._grams([b"Xbcde1 Ybcde2"], ppm.ORDER)
    contexts = {int(g) >> 8 for g in grams if int(g) & 0xFF in b"12"}
    assert {c.to_bytes(8, "big")[-5:] for c in contexts} == {b"Xbcde", b"Ybcde"}
