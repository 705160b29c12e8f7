import pytest

from filmloom import config as C


def test_options_win_over_profiles():
    built = C.build("credits", **{"filters.min_contrast": 0.3})
    assert built.filters.min_contrast == 0.3
    assert built.filters.roi == "full" and built.temporal.mode == "max"
    assert C.build().filters.roi == "bottom:0.30"
    with pytest.raises(ValueError):
        C.build("cinema")


@pytest.mark.parametrize(
    "text,box", [("full", (0, 0, 1, 1)), ("", (0, 0, 1, 1)), ("top:0.25", (0, 0, 1, 0.25)), ("bottom:0.25", (0, 0.75, 1, 1)), ("0.1,0.2,0.3,0.4", (0.1, 0.2, 0.3, 0.4))]
)
def test_roi(text, box):
    assert C.parse_roi(text) == pytest.approx(box)


@pytest.mark.parametrize("text", ["bottom:0", "top:1.5", "0.5,0,0.2,1", "middle", "1,2"])
def test_bad_roi(text):
    with pytest.raises(ValueError):
        C.parse_roi(text)


def test_frames_and_halo():
    assert C.parse_frames("12, 40,0-6:3") == [0, 3, 6, 12, 40]
    with pytest.raises(ValueError):
        C.parse_frames("a-b")
    assert C.Config().halo == 4 + 1 + 10
    assert C.build("subtitles").halo == 16


def test_registry_reaches_every_option():
    names = C.option_names()
    assert C.coerce("temporal.window", "4.6") == 5 and C.coerce("strokes.solidify", "off") is False
    for name, kind in names.items():
        section, _, key = name.partition(".")
        assert isinstance(getattr(getattr(C.Config(), section), key), kind)
