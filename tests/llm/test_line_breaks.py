"""Words behind line breaks are kept by the encoder like any other word."""

from ragloom.llm import tokenize as T


def test_known_lines_are_not_encoded_again(monkeypatch):
    unseen, look = [], T._Words.__missing__
    monkeypatch.setattr(T._Words, "__missing__", lambda self, word: unseen.append(word) or look(self, word))
    enc = T.Encoder(T.default_path())
    texts = ["one two\nthree four\nfive,\n6 é\nß\na", "two\nthree", "a b\n\nc", "\na\nb", "a\nb\n"]
    raw = [t.encode() for t in texts]
    first = enc.ids(raw)
    assert first == [enc.whole(t) for t in texts]
    unseen.clear()
    assert enc.ids(raw) == first and not unseen
