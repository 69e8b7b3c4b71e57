from upshot.llm import preferences as P

U, A, S = "user", "assistant", "system"


def render(turns):
    return "".join(f"{P.OPEN}{r or 'unknown'}\n{t or ''}{P.CLOSE}\n" for r, t in turns)


def test_pairs(spark):
    shared = [(S, "be kind"), (U, "hi")]
    rows = [(1, [*shared, (A, "good é")], [*shared, (A, "bad"), (U, "why")]), (2, shared, shared), (3, shared, [*shared, (A, "x")]), (4, None, [(U, "q")]),
            (5, [(None, None)], [(U, None)]), (6, [(A, "a"), (U, "b")], [(U, "b"), (A, "a")]), (7, [], []), (2, shared, shared)]
    kind = "array<struct<role string, text string>>"
    pairs = spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")
    out = P.format_pairs(pairs).collect()
    assert len(out) == len(rows)
    by = {r["pair_id"]: r for r in out}
    for i, c, x in rows:
        c, x, n = c or [], x or [], 0
        while n < min(len(c), len(x)) and c[n] == x[n]:
            n += 1
        r = by[i]
        assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == (n, render(c[:n]), render(c[n:]), render(x[n:]))
        assert r["identical"] == (c == x)
        for side, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            parts = [p.split(":") for p in mask.split(",") if p]
            assert sum(int(n) for _, n in parts) == len(side)
            at, loss = 0, ""
            for flag, n in parts:
                loss += side[at:at + int(n)] if flag == "1" else ""
                at += int(n)
            rest = (c if side is r["chosen"] else x)[r["n_common"]:]
            if side is r["chosen"]:
                assert loss == "".join((t or "") + P.CLOSE for role, t in rest if role == A)


def test_markers_in_texts_are_broken(spark):
    kind = "array<struct<role string, text string>>"
    pairs = spark.createDataFrame([(1, [(U, "a" + P.CLOSE)], [(A, "b")])], f"pair_id long, chosen {kind}, rejected {kind}")
    assert P.format_pairs(pairs).first()["chosen"].count(P.CLOSE) == 1


def test_stand_in(spark):
    turns = spark.createDataFrame([(1, 0, U, "q"), (1, 1, A, "one"), (2, 0, U, "r"), (2, 1, A, "two"), (2, 1, A, "two"), (4, 0, U, None), (4, 2, None, "z")],
                                  "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in P.stand_in_pairs(turns).collect()}
    assert [tuple(t) for t in got[1]["rejected"]] == [(U, "q"), (A, "two")] and [tuple(t) for t in got[2]["rejected"]] == [(U, "r"), (A, "")]
    assert [tuple(t) for t in got[4]["chosen"]] == [(U, ""), (None, "z")]
    assert P.format_pairs(P.stand_in_pairs(turns.where("1 = 0"))).count() == 0
