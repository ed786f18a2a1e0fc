"""Words of letters are asked for together, with the ids that the library gives for each."""

from textforge.llm.word_ids import TOGETHER, WordEncoder, vocabulary


def test_letter_words_are_asked_together():
    encoder, asked = WordEncoder(vocabulary()), []
    library = encoder.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **how)

    encoder.tokenizer = Counting()
    words = [f"{a}{b}{c}ßéªµ" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    text = " ".join([*words, "it's", "x1", "end.", "don't!!", "日本", "İx"])
    want = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert list(memoryview(got).cast("I")) == want and len(asked) < len(words) // TOGETHER + 20


class _Asked(dict):
    """A dictionary that can be asked for a word, not gone through."""

    def __iter__(self):
        raise AssertionError("gone through")


def test_the_generation_before_is_not_gone_through():
    e = WordEncoder(vocabulary())
    want = e.encode("the ring, a bolt and 42 gears")
    e.known, e.older = {}, _Asked(e.known)
    assert e.encode("the ring, a bolt and 42 gears") == want and e.encode("the new ring") == e.encode("the") + e.encode("new") + e.encode("ring")
    assert e.older["ring"] == e.known["ring"]
