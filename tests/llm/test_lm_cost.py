"""What operator 10 does once, or not at all, to stay cheap; each with the results that it had."""

import numpy as np
import pyarrow as pa

from tessera.llm import attention, lmscore
from tessera.llm.textarrays import Texts
from tessera.llm.tokens import SEPARATOR, WordTokenizer, vocabulary

ODD = ["<|endoftext|>x <|startoftext|> a<|b x<|EndOfText|>", "it's WE'LL don't 'S'T ''s a'b '", f"a{SEPARATOR}b {SEPARATOR} x{SEPARATOR}", "\x7f\x00 \x1c\x1d a\x85b", "H̱ ẖ KK İstanbul ΣAΣ", "ā Ā xāy", "12ab3.4$$$%% ___ a_b <| |> <", "", None, "日本語abc é é ﬁ x²", "Plain words, and Plain Ones"]


class Seen:
    """A tokenizer that keeps what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **more)

    def encode(self, text, **more):
        self.texts.append(text)
        return self.tokenizer.encode(text, **more)


def test_plain_words_do_without_the_normaliser():
    t = WordTokenizer(vocabulary())
    full = t.tokenizer
    t.tokenizer = Seen(full)
    ids, counts = t.encode(Texts.of(pa.array(ODD)))
    want = [full.encode(" ".join(words_of(x)), add_special_tokens=False).ids for x in ODD]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    asked = " ".join(t.tokenizer.texts)
    assert "Plain" not in asked and "<|endoftext|>x" in asked and "İstanbul" in asked


def words_of(text):
    """Words of a text between ASCII white space."""
    return (text or "").translate(dict.fromkeys([*range(9, 14)], " ")).split(" ")


def test_few_windows_are_scored_together(monkeypatch):
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 59, 20000)
    m = attention.train_attention(ids, np.full(400, 50), 60, 59, steps=3, batch=8)
    whole, sizes, plain = m.score(ids, np.array([20000])), [], attention.AttentionModel.logits
    monkeypatch.setattr(attention.AttentionModel, "logits", lambda self, rows, first: (sizes.append(len(rows)), plain(self, rows, first))[1])
    assert np.allclose(m.score(ids, np.array([20000])), whole)
    assert max(sizes) <= 128 < sum(sizes)  # 512 before: their arrays left the core's cache


def test_steps_are_those_of_each_parameter():
    rng = np.random.default_rng(1)
    p = {"a": rng.standard_normal((3, 4)).astype(np.float32), "b": rng.standard_normal(5).astype(np.float32)}
    fit = attention.Descent(p)
    want, m, s = {k: v.copy() for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}
    for t in range(1, 30):
        g = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in p.items()}
        fit.step(g, 0.01)
        for k, x in g.items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * x, 0.99 * s[k] + 0.01 * x * x
            want[k] = want[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
    assert all(np.allclose(fit.p[k], want[k], rtol=1e-4, atol=1e-5) for k in p)
    assert not np.shares_memory(fit.flat, p["a"])


def test_subwords_are_counted_once_for_fit_and_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"alpha beta w{k % 7} " * (k % 5)) for k in range(60)], "doc_id long, text string")
    coded = lmscore.code_documents(docs, vocabulary())
    sizes, plain = [], lmscore.gathered
    monkeypatch.setattr(lmscore, "gathered", lambda c, cells, size: (sizes.append(size), plain(c, cells, size))[1])
    assert lmscore.score_coded(coded, lmscore.fit_attention(coded)).count() == 60
    assert sizes.count(coded.pairs.vocab) == 1  # twice before
