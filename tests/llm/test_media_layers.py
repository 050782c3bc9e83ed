import pytest

from lexloom.llm import media


@pytest.mark.parametrize("layer,second", [(1, 0xFE), (2, 0xFC)])
def test_protected_frames_of_other_layers_are_unverified(layer, second):
    head = bytes([0xFF, second, 0x54, 0x00])
    h = media.header(head)
    assert h.layer == layer and h.protected
    s = media.parse((head + bytes(h.length - 4)) * 3)
    assert (len(s.offsets), s.bad, s.unverified) == (3, 0, 3)
    assert media.feature(s).endswith(";unverified=3")


def test_stored_streams_are_verified():
    s = media.parse(media.store(media.pad(b"text")))
    assert s.unverified == 0 and "unverified" not in media.feature(s)
