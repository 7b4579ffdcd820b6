"""One sample of every form in which a secret is told apart, and plain look-alikes of them."""

from __future__ import annotations

import pytest

from tapeline.llm import secrets
from tapeline.session import as_table

FORMS = [
    ('password = "Sup3rSecret!"', "Sup3rSecret!"),
    ('{"password": "Sup3rSecret!"}', "Sup3rSecret!"),
    ("db_password = hunter2hunter", "hunter2hunter"),
    ("api-key: a8Kd02mQx1", "a8Kd02mQx1"),
    ("access_key=Zk39dLq20Pw", "Zk39dLq20Pw"),
    ("passphrase: q7Wm2xT9bR4c", "q7Wm2xT9bR4c"),
    ("Authorization: Bearer q7Wm2xT9bR", "q7Wm2xT9bR"),
    ("postgres://u:p4ssw0rd@h/db", "p4ssw0rd"),
    ("the ghp_" + "abcdefGHIJklmnopQRSTuvwxYZabcdefGHIJ" + " is", "ghp_abcdefGHIJklmnopQRSTuvwxYZabcdefGHIJ"),
]
PLAIN = ["The password: required by all.", "the bearer something else", "see http://example.com:8080/a and mail joe@example.com", "token = os.environ[x]"]


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(spark)


def test_forms(spark, model):
    docs = as_table(spark.createDataFrame(list(enumerate([f"so {t} it went" for t, _ in FORMS] + PLAIN)), "doc_id long, text string"), "forms")
    candidates = {(r.doc_id, r.secret) for r in secrets.candidates(docs, ["doc_id"], "text", secrets.F.lit("")).collect()}
    assert {(k, v) for k, (_, v) in enumerate(FORMS)} <= candidates
    found = {r.doc_id: (r.start, r.end) for r in secrets.scan(docs, model=model).collect()}
    assert found == {k: (3 + t.index(v), 3 + t.index(v) + len(v)) for k, (t, v) in enumerate(FORMS)}
    cut = {r.doc_id: r.text for r in secrets.redact(docs, model=model).collect()}
    assert all(cut[k] == f"so {t} it went".replace(v, secrets.MARK) for k, (t, v) in enumerate(FORMS))


def test_the_path_moves_a_score(spark, model):
    rows = [(1, "password = dev42river", "src/app/settings.py"), (2, "password = dev42river", "tests/fixtures/settings.py"), (3, "key AKIA" + "Z3X9Q2W7E5R1T8Y6", "tests/a.py")]
    docs = as_table(spark.createDataFrame(rows, "doc_id long, text string, source string"), "paths")
    score = {r.doc_id: r.score for r in secrets.judged(docs, ["doc_id"], "text", secrets.F.col("source"), model).collect()}
    assert score[1] > score[2] + 0.1 and min(score[1], score[3]) > 0.5


def test_sixteen_thousand_candidates_in_one_text(spark, model):
    import time

    text = " ".join(f"commit {k:040x} token=a8Kd02mQ{k:05d}" for k in range(8000))
    docs = as_table(spark.createDataFrame([(1, text), (2, None), (2, "")], "doc_id long, text string"), "many")
    begin = time.perf_counter()
    got = secrets.scan(docs, model=model).collect()
    assert time.perf_counter() - begin < 20 and len(got) == 8000
    assert all(text[r.start : r.end].startswith("a8Kd02mQ") for r in got)
    cut = {r.doc_id: r.text for r in secrets.redact(docs, model=model).where("doc_id = 1").collect()}
    assert cut[1] == " ".join(f"commit {k:040x} token={secrets.MARK}" for k in range(8000))
