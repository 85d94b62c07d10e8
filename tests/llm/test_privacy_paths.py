"""Revealing terms are the same whether they travel with the code or are joined."""

import random

import pytest
from test_corpus import docs_frame, prose

from pixeltide.llm import privacy


@pytest.mark.parametrize("everywhere", [True, False])
def test_carried_and_joined_terms_agree(spark, monkeypatch, everywhere):
    rng = random.Random(21)
    rows = [(i, prose(rng, 50)) for i in range(300)]
    rows += [(1000 + k, f"{prose(rng, 30)} ZORBLAX {prose(rng, 20)} ann@corp.example {prose(rng, 9)} zorblax") for k in range(8)]
    rows += [(2000 + k, f"{prose(rng, 30)} Quixby {prose(rng, 20)} +49 170 1234567 {prose(rng, 9)}") for k in range(8)]
    rows += [(3000, "zorblax and quixby, no address"), (3001, "quixby, bob@corp.example"), (None, "İ Zorblax"), (3002, None), (3003, ""), (3001, "quixby, bob@corp.example")]
    docs = docs_frame(spark, rows)
    found = []
    for most in (privacy.CARRIED, -1):
        monkeypatch.setattr(privacy, "CARRIED", most)
        spans = sorted((r.doc_id or -1, r.n_term, r.spans) for r in privacy.report(docs, everywhere=everywhere).collect())
        clean = sorted((r.doc_id or -1, r.text or "") for r in privacy.sanitised(docs, everywhere=everywhere).collect())
        found.append((spans, clean))
    assert found[0] == found[1]
    texts = dict(found[0][1])
    assert ("[TERM] and [TERM]" in texts[3000]) == everywhere and "[TERM]" in texts[1000] and "[TERM]" in texts[2000]
    assert sum(n for _, n, _ in found[0][0]) >= 24
