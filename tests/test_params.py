"""Parameters, symbols and colours."""

import pytest

from barweave.functions import params as I


def test_inputs_resolve_by_id_title_default():
    i = I.Inputs({"n": 7, "Source length": 9})
    assert (i.int("n", 14), i.int("m", 14, "Source length"), i.float("f", 1.5), i.string("s", "a", options=("a", "b"))) == (7, 9, 1.5, "a")
    assert set(i.declared) == {"n", "m", "f", "s"}
    with pytest.raises(ValueError):
        I.Inputs({"n": 0}).int("n", 14, minval=1)


def test_symbols():
    assert I.ticker("BTC", "X", "regular") == "X:BTC;session=regular"
    assert (I.plain_symbol("", "A"), I.plain_symbol("X:B;m=1", "A"), I.standard("X:B;m=1")) == ("A", "B;m=1", "X:B")


def test_colors():
    assert I.color_parts(I.color_new("red", 50))[3] == pytest.approx(50, abs=0.3)
    assert I.color_parts(I.color_rgb(1, 2, 3)) == (1, 2, 3, 0.0)
    with pytest.raises(ValueError):
        I.color_parts("#12")
