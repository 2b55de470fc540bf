"""Pieces are encoded many to a text, with the ids of whole texts."""

import random

import pyarrow as pa

from corvane.llm._tokens import PieceEncoder, file_of


class Counted:
    """A tokenizer that counts the texts that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_in_rows():
    """The library is not given a text for each new word (op3_repair_tokens, round 3)."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgzäß中é0123AB") for _ in range(r.randint(1, 9)))
    texts = ["".join(r.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n ", "\n\n"]) + word() + r.choice(["", "", "", ",", "'s", "-", " ", "!?"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += ["", "  ", "a", "  b c", "x <|endoftext|> y", " a\x1cb c", None]
    encoder = PieceEncoder(file_of("byte_bpe_50k.json"))
    plain, encoder.tokenizer = encoder.tokenizer, Counted(encoder.tokenizer)
    ids, counts = encoder.encode_column(pa.array(texts))
    whole = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]
    words = sum(p[:1].isspace() and p[1:].decode().isalnum() for p in encoder.known)
    assert words > 2_000 and encoder.tokenizer.texts < len(encoder.known) - words + 5
