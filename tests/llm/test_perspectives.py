from hushframe.llm.perspectives import rotate

ROWS = [(1, 0, "system", "be 😀", 1), (1, 1, "ann", "hi", 2), (1, 2, "bob", "yo\nthere", 3), (1, 3, "ann", None, 4), (1, 3, "ann", None, 4), (2, 5, None, "é", 1), (2, 5, None, "a", 1), (None, 1, "x", "y", 1), (3, None, "x", "y", 1), (4, 0, "system", "alone", 1)]


def brute(rows, part):
    turns = {(c, t, r or "unknown", x or "") for c, t, r, x, _ in rows if c is not None and t is not None}
    out = []
    for c in {t[0] for t in turns}:
        own = sorted(t[1:] for t in turns if t[0] == c)
        for who in {w for _, w, _ in own} - {"system"}:
            whole = 0
            for p in sorted({t // part for t, _, _ in own}):
                text, mask = "", []
                for t, w, x in own:
                    if t // part == p:
                        text += "<|im_start|>" + ("assistant" if w == who else "system" if w == "system" else f"user name={w}") + "\n"
                        if w == who:
                            mask.append(f"{len(text)}:{len(text) + len(x)}")
                        text += x + "<|im_end|>\n"
                out.append((c, who, p, whole, text, ",".join(mask)))
                whole += len(text)
    return sorted(out)


def test_equals_brute_force(spark):
    rows = ROWS + [(9, t, f"s{t % 3}", f"text {t}" * (t % 5), 0) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    for part in (2, 64):
        assert sorted(map(tuple, rotate(df, part=part).collect())) == brute(rows, part)
    assert rotate(df.limit(0)).count() == 0
