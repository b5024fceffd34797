from tonekit.llm.chat import linked, op9_chat

TALK = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    return {(r["conv_id"], r["turn"]): r for r in linked(spark.createDataFrame(rows, TALK)).collect()}


def test_nested_quotes(spark):
    got = run(spark, [
        (1, 0, "user", "Is it cold?\n\nBring   a coat."),
        (1, 1, "assistant", "Yes, very."),
        (1, 2, "user", "Ann wrote:\n> bring a COAT.\nWhich one?"),
        (1, 3, "assistant", "> > Bring a coat.\n> Which one?\nThe blue one.\n>Yes, very.\nIndeed."),
        (1, 4, "user", "> never said\nok"),
        (2, 0, "user", "> Is it cold?\nother talk"),
    ])
    assert [(k, r["reply_to"], r["quoted_turn"], r["max_level"]) for k, r in sorted(got.items())] == [
        ((1, 0), None, None, 0), ((1, 1), 0, None, 0), ((1, 2), 0, 0, 1), ((1, 3), 2, 2, 2), ((1, 4), 3, None, 1), ((2, 0), None, None, 1)]
    assert got[1, 2]["content"] == "Which one?" and got[1, 3]["content"] == "The blue one.\nIndeed."
    assert got[1, 3]["n_quotes"] == 3 and got[1, 4]["content"] == "ok"
    assert got[1, 1]["formatted"] == "<|assistant|>\nYes, very.\n<|end|>"


def test_long_conversation_and_ties(spark):
    rows = [(7, t, "user", f"message {t}" if t % 10 else f"> message {t - 3}\nanswer {t}") for t in range(0, 2000, 2)]
    rows += [(7, 4, "user", "message 4"), (7, 4, "user", "message 4")]
    out = linked(spark.createDataFrame(rows, TALK)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["reply_to"] == (None if r["turn"] == 0 else r["turn"] - 2)
    rows = [(1, t, "user", "same words") for t in range(4)] + [(1, 9, "user", "> same words\nlatest counts")]
    assert run(spark, rows)[1, 9]["reply_to"] == 3


def test_odd_rows(spark, put):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (1, None, "user", "x"), (None, 3, "user", "> x"), (1, 2, "user", "> a\n>> b\n"),
            (1, 3, "user", "a > b\n-> c"), (1, 4, "user", "w " * 50_000)]
    got = linked(spark.createDataFrame(rows, TALK)).collect()
    assert len(got) == 7
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 2]["content"] == "" and by[1, 2]["reply_to"] == 1 and by[1, 3]["content"] == "a > b\n-> c"
    assert by[1, None]["reply_to"] is None and by[None, 3]["reply_to"] is None
    assert op9_chat(spark, put("conversations", [], TALK)).collect() == []
    extra = spark.createDataFrame([(1, 0, "u", "t", 5, "h")], TALK + ", level int, hash string")
    assert linked(extra).first()["content"] == "t"


def test_op9_keeps_every_message(spark, sf_dir, rows):
    out = op9_chat(spark, sf_dir)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    talk = rows("conversations", "conv_id, turn, role, text")
    last, want = {}, []
    for c, t, r, x in sorted(talk):
        want.append((c, t, r, x.strip(), last.get(c)))
        last[c] = t
    assert sorted((r["conv_id"], r["turn"], r["role"], r["content"], r["reply_to"]) for r in out.collect()) == want


def test_partial_quotes_and_nested_attributions(spark):
    three = "First part,\nsecond line,\nthird line,\nlast line.\n\nMiddle part.\n\nFinal part."
    got = run(spark, [
        (1, 0, "user", three), (1, 1, "assistant", "Something else."), (1, 2, "user", "Middle part."), (1, 3, "assistant", "No."),
        (1, 4, "user", "> Middle part.\n>\n> Final part.\nTwo of three."),  # turn 2 holds one of the units only
        (1, 5, "user", "> second line,\n> third line,\nTwo lines."),
        (1, 6, "user", "> Middle part.\nThe latest."),
        (1, 7, "user", "> Ann wrote:\n> Middle part.\n> Final part.\nNot nested."),
        (2, 0, "ann", "A text"), (2, 1, "ben", "Ann wrote:\n> A text\nB text"), (2, 2, "cy", "C"),
        (2, 3, "dee", "Ben wrote:\n> B text\n>\n> Ann wrote:\n>> A text\nD text"),
        (2, 4, "eve", "> Ann wrote:\n>> A text\nE text"), (2, 5, "fay", "> Dee wrote:\n>> Ben wrote:\n>>> B text\nF text"),
    ])
    assert [got[1, t]["reply_to"] for t in (4, 5, 6, 7)] == [0, 0, 2, 0]
    assert [(got[2, t]["reply_to"], got[2, t]["max_level"], got[2, t]["n_quotes"]) for t in (1, 3, 4, 5)] == [
        (0, 1, 1), (1, 2, 2), (0, 2, 1), (1, 3, 1)]
    assert [got[2, t]["content"] for t in (1, 3, 4, 5)] == ["B text", "D text", "E text", "F text"]


def test_threads_and_long_quotes(spark):
    rows = [(1, 0, "a", "first words"), (1, 1, "b", "second words"), (1, 2, "c", "> first words\nthird"), (1, 3, "d", "> third\nfourth"),
            (2, 5, "a", "alone"), (None, 1, "a", "x"), (1, None, "a", "y")]
    rows += [(3, t, "u", f"m{t}") for t in range(100)]
    got = run(spark, rows)
    assert [(got[1, t]["root"], got[1, t]["depth"]) for t in range(4)] == [(0, 0), (0, 1), (0, 1), (0, 2)]
    assert (got[2, 5]["root"], got[2, 5]["depth"]) == (5, 0) and got[None, 1]["depth"] == 0 and got[1, None]["root"] is None
    assert all((got[3, t]["root"], got[3, t]["depth"]) == (0, t) for t in range(100))
    import time
    took = {}
    for n in (2000, 16000):
        text = "\n".join(">" * (1 + i % 2) + f" line {i}" for i in range(n))
        t = time.time()
        (r,) = run(spark, [(1, 0, "u", text)]).values()
        took[n] = time.time() - t
        assert r["n_quotes"] == n and r["max_level"] == 2 and r["content"] == ""
    assert took[16000] < 16 * max(took[2000], 1.0)


def test_against_plain_linker(spark):
    """Random quoted conversations against a linker over all earlier messages."""
    import random
    import re
    r = random.Random(8)

    def units(text):
        norm = lambda x: re.sub(r"[\s>]+", " ", x).strip(" ").lower()
        parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
        return {norm(p) for p in parts} - {""}

    rows, want = [], {}
    for conv in range(12):
        own = {}
        for turn in range(r.randint(1, 14)):
            body = "\n".join(r.choice(["alpha", "beta gamma", "delta", "", "epsilon zeta eta"]) for _ in range(r.randint(1, 4)))
            quoted = []
            for level in range(1, r.randint(1, 3)):
                quoted.append((level, "\n".join(r.choice(["alpha", "Beta  gamma", "unknown", "delta", "theta"]) for _ in range(r.randint(1, 3)))))
            lines = ["> " * level + x for level, q in quoted for x in q.split("\n")]
            rows.append((conv, turn, "u", "\n".join(lines + [body])))
            answer = None
            for level, q in sorted(quoted):
                hits = [(len(units(q) & units(own[t])), t) for t in own if units(q) & units(own[t])]
                if hits:
                    answer = max(hits)[1]
                    break
            want[conv, turn] = answer
            own[turn] = re.sub(r"^\s+|\s+$", "", re.sub(r"\n{3,}", "\n\n", body))
    got = run(spark, rows)
    assert {k: r["quoted_turn"] for k, r in got.items()} == want and sum(v is not None for v in want.values()) > 20
