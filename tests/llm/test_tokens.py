"""Ids put together from remembered pieces equal the library's ids of whole texts."""
import random

from readloom.llm import tokens as T

BITS = ["foo", "Été", "ß", "don't", "'s", "5", "½", ".", ",", ";", "!", "?", "...", ")", "(", "\n", "\n\n", " ", "  ", "\t", "\r\n", "-", "_", "\x01", "\x02", "\x03", "日本", "a.b", "\x1c", "\x85"]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(T, "REMEMBER", 300)
    rng, enc = random.Random(5), T.Encoder("byte_bpe_50k.json")
    one = lambda: rng.choice(BITS) if rng.random() < 0.6 else rng.choice(["word", "Line"]) + rng.choice([" ", ". ", ", ", ".\n"])
    for _ in range(20):
        texts = ["".join(one() for _ in range(rng.randint(0, 14))) for _ in range(200)]
        want = [x.ids for x in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(texts)] == want


def test_new_words_go_to_the_model():
    """Words of letters, and signs after them, have the ids of whole texts without a call of the whole tokenizer."""
    rng, enc = random.Random(6), T.Encoder("byte_bpe_50k.json")
    signs, letters = T._SIGNS, "abcdefghijklmnopqrstuvwxyzABCDEÀÖØöøÿéßñ"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 12))) + "".join(rng.choices(signs, k=rng.choice([0, 0, 1, 3])))
    texts = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += ["<|endoftext|> a<|endoftext|>b", "x |endoftext|> <|endoftext", "it's don't $'s a's*** ' ''"]
    want = [x.ids for x in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    asked, ids = [], enc.ids
    enc.ids = lambda text: asked.append(text) or ids(text)
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert sum(map(len, asked)) < sum(map(len, texts)) / 5
    other = T.Encoder("byte_bpe_50k.json")
    other.model = None  # as with a tokenizer that cuts words otherwise
    assert [x.tolist() for x in other.encode(texts)] == want
