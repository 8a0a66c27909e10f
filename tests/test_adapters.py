"""Retries, key rotation and the chain of fallbacks, with services that fail as told."""

import pytest

from quillmere.sources import adapters


def test_keys_rotate_and_delays_are_as_suggested():
    waits, calls = [], []

    def service(name, *outcomes):
        left = list(outcomes)

        def call(texts):
            calls.append(name)
            now = left.pop(0) if left else None
            if now:
                raise now
            return [f"{name}:{t}" for t in texts]

        return call

    one = service("k1", adapters.QuotaError("used up"), adapters.QuotaError("again"))
    two = service("k2", adapters.QuotaError("used up", 7.5), None)
    patient = adapters.Patient([one, two], pause=65, sleep=waits.append)
    assert patient(["x"]) == ["k2:x"] and calls == ["k1", "k2", "k1", "k2"] and waits == [9.5]
    assert patient([]) == [] and patient(["y"]) == ["k1:y"] and waits == [9.5, 65]
    waits.clear()
    failing = adapters.Patient([service("k", *(OSError("down") for _ in range(9)))], tries=3, sleep=waits.append)
    with pytest.raises(RuntimeError, match="3 rounds"):
        failing(["x"])
    assert waits == [10, 20, 30]


def test_one_text_that_fails_costs_no_other(spark):
    def first(texts):
        if any("bad" in t or "worst" in t for t in texts):
            raise ValueError("no")
        return [f"1 {t}" for t in texts]

    def second(texts):
        if any("worst" in t for t in texts):
            raise OSError("down")
        return [f"2 {t}" for t in texts]

    rows = [(k, "bad one" if k % 10 == 0 else "worst" if k == 7 else None if k == 8 else f"text {k}") for k in range(50)]
    got = {r.id: r.answer for r in adapters.call_chain(spark.createDataFrame(rows, "id long, t string"), "t", {"primary": first, "secondary": second}, batch=8).collect()}
    assert {k for k, a in got.items() if a.hop == "secondary"} == {0, 10, 20, 30, 40} and got[10].text == "2 bad one" and got[10].errors == ["primary: ValueError"]
    assert got[7].hop is None and got[7].text is None and got[7].errors == ["primary: ValueError", "secondary: OSError"]
    assert got[8].text == "1 " and got[3].text == "1 text 3" and got[3].errors == []
    single = adapters.call_chain(spark.createDataFrame([(1, "worst")], "id long, t string"), "t", {"primary": first, "secondary": second}, batch=1).first().answer
    assert single.errors == ["primary: ValueError", "secondary: OSError"]
