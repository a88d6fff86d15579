"""Words of letters get their ids from the library's model, the rest of a text from the whole library."""

import numpy as np

from tidewright.llm import packing


class Counted:
    """A library that remembers what it was asked to encode as a whole."""

    def __init__(self, library):
        self.library, self.asked = library, []

    def encode_batch_fast(self, parts, **more):
        self.asked += parts
        return self.library.encode_batch_fast(parts, **more)


def test_words_are_encoded_by_the_model():
    text = "Some words, na\u00efvet\u00e9 and Stra\u00dfe. \u00c0\u00ff qzxwvk donaudampfschifffahrt; it's 12 o'clock.\nna\u00efvet\u00e9 again"
    for direct in (True, False):
        encode = packing.Encoder(packing.default_model())
        assert encode.direct
        encode.direct, encode.library = direct, Counted(encode.library)
        ids = np.frombuffer(encode(text.encode()), encode.kind)
        assert ids.tolist() == [*encode.library.library.encode(text, add_special_tokens=False).ids, packing.END]
        words = {"some", "words", "na\u00efvet\u00e9", "and", "stra\u00dfe", "\u00e0\u00ff", "qzxwvk", "donaudampfschifffahrt", "again"}
        assert words & set(encode.library.asked) == (set() if direct else words)
