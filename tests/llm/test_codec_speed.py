"""What the codec of operator 6 need not make anew for each text."""

import numpy as np
import pytest

from tesserix.llm import webp


def test_codes_and_distances_of_every_image_are_made_once():
    """Codes of one symbol, the code of codes' lengths and the short distances are the same for all images."""
    rng = np.random.default_rng(1)
    for text in (b"the quick brown fox jumps over the lazy dog, " * 40, rng.integers(97, 117, 6400).astype(np.uint8).tobytes(), bytes(range(256)) * 25):
        payload = text + b"\0" * (-len(text) % 64)
        assert webp.unpack_bytes(webp.store_bytes(payload)).tobytes() == payload
    for made in (webp._lone, webp._code_of, webp._near_pixels):
        assert made.cache_info().hits > 0 and made.cache_info().misses <= 5
    w = webp.BitWriter()
    webp._put_simple(w, [200])
    with pytest.raises(ValueError, match="beyond the alphabet"):
        webp._read_prefix(webp.Bits(w.done()), 40)
