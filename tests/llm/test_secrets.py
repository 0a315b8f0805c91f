import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import secrets


def key(draw, n, letters):
    return "".join(draw.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(6)
    texts, truth = [], []
    for i in range(300):
        words = [draw.choice(["the", "house", "tree", "water", "light", "running"]) for _ in range(40)]
        kind = i % 6
        value = {
            0: f'token = "{key(draw, 40, "0123456789abcdef")}"', 1: f"password={key(draw, 18, '0123456789abcdef')}",
            2: "AKIA" + key(draw, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 3: key(draw, 16, "0123456789"),
            4: f"user.{draw.randint(10, 99)}@mail{draw.randint(1, 9)}.example.com", 5: f"/usr/lib/module{draw.randint(10, 99)}/file.py"}[kind]
        words.insert(draw.randrange(len(words)), value)
        texts.append(" ".join(words))
        truth.append(re.sub(r'.*[="]([0-9a-f]{18,40})"?$', r"\1", value) if kind < 3 else None)
    return texts, truth


def test_forest_keeps_secrets_and_removes_the_rest(documents, planted):
    texts, truth = planted
    got = secrets.scan_secrets(documents(*texts)).collect()
    assert all(texts[r.doc_id][r.start:r.start + len(r.value)] == r.value for r in got)
    found = {(r.doc_id, r.value) for r in got if r.is_secret}
    assert found == {(i, t) for i, t in enumerate(truth) if t}
    assert sum(not r.is_secret for r in got) >= 140


def test_labels_that_are_given_decide(documents, planted, spark):
    texts, _ = planted
    rows = [(key(random.Random(i), 16, "0123456789"), "number ", " end", "s", 1.0) for i in range(60)]
    rows += [(key(random.Random(i), 40, "0123456789abcdef"), 'token = "', '" end', "s", 0.0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "value string, before string, after string, source_name string, label double")
    got = secrets.scan_secrets(documents(*texts), labelled).collect()
    assert all(r.is_secret for r in got if re.fullmatch("[0-9]{16}", r.value))
    assert not any(r.is_secret for r in got if re.fullmatch("[0-9a-f]{40}", r.value))


def test_redaction_changes_secrets_only(documents, planted):
    texts, truth = planted
    rows = documents(*texts).withColumns({"value": F.lit("mine"), "score": F.lit(1)})
    got = secrets.redact(rows)
    assert got.columns == rows.columns
    for r in got.collect():
        expected = texts[r.doc_id].replace(truth[r.doc_id], "[SECRET]") if truth[r.doc_id] else texts[r.doc_id]
        assert r.text == expected and r.n_chars == len(expected)


def test_assigned_values_of_any_kind_are_secrets(documents, planted):
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzkQ5vTq8Ls"
    short = {
        'password = "hunter2!Xy" end': "hunter2!Xy", "password=correcthorsebattery end": "correcthorsebattery",
        "DB_PASS=S3cr3t!pass#word$2024 end": "S3cr3t!pass#word$2024",
        'api_key = "abcdEFGHijklMNOPqrstUVWXyzab" end': "abcdEFGHijklMNOPqrstUVWXyzab", "token: 9f8e7d6c5b4a": "9f8e7d6c5b4a",
        f"aws_secret_access_key = {aws}, end": aws, "db2.production.password=Xy7 Xy7": "Xy7"}
    texts = [*short, *planted[0]]
    rows = documents(*texts)
    got = {(r.doc_id, r.value) for r in secrets.scan_secrets(rows).collect() if r.is_secret}
    assert {(i, v) for i, v in enumerate(short.values())} <= got
    left = {r.doc_id: r.text for r in secrets.redact(rows).collect()}
    assert [left[i] for i in range(len(short))] == [t.replace(v, "[SECRET]", 1) for t, v in short.items()]


def test_passwords_in_addresses_are_secrets(documents, planted):
    secret = {
        "see postgres://admin:S3cretPw9xQ@db.example.com/prod now": "S3cretPw9xQ",
        "clone https://bob:k2Jx81mQpz0Lr5Wv7TnYb3Hd@git.host.io/x.git": "k2Jx81mQpz0Lr5Wv7TnYb3Hd",
        "redis://:p4ssOnly@10.0.0.7:6379": "p4ssOnly", "amqp://svc.user:a%2Fb:c9@[::1]/v": "a%2Fb:c9"}
    plain = ["https://host.io:8080/path/file@v2 end", "ratio 3:4@noon and ssh://git@host.io/x", "mail me: joe@mail.example.com"]
    texts = [*secret, *plain, *planted[0]]
    rows = documents(*texts)
    left = {r.doc_id: r.text for r in secrets.redact(rows).collect()}
    assert [left[i] for i in range(len(secret))] == [t.replace(v, "[SECRET]", 1) for t, v in secret.items()]
    assert [left[i] for i in range(len(secret), len(secret) + len(plain))] == plain


def test_odd_rows(documents, planted):
    texts, _ = planted
    secret = texts[2]
    rows = documents((None, secret, None, None, None), (1, secret, "en", None, 1), (1, secret, "en", None, 1), (2, None, "en", "s", 0),
                     (3, "", "en", "s", 0), (4, "word " * 200_000 + secret, "en", "s", 0), *[(9, t, "en", "s", len(t)) for t in texts[:40]])
    got = secrets.redact(rows).collect()
    assert len(got) == 46
    assert not any("AKIA" in (r.text or "") for r in got)
    assert [r.text for r in got if r.doc_id in (2, 3)] == [None, ""]
    few = secrets.scan_secrets(documents("password=abcdef9182736450ab")).collect()  # one class only
    assert [(r.start, r.is_secret) for r in few] == [(9, True)]
    empty = rows.where("false")
    assert secrets.scan_secrets(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_no_python_runs_on_the_rows(documents, planted):
    plan = secrets.redact(documents(*planted[0][:60]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
