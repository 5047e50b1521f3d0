import hashlib
import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from tidegauge.llm import chat


def brute(rows):
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n if n is not None else -1, r or "", t or ""))
    out = {}
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r[1:5]) for r in df.collect()}


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, window int, mask string").repartition(3)


def test_conversations(table):
    conv = table("conversations")
    assert got(chat.read_back(chat.chat_windows(conv))) == brute([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])


def test_windows(spark):
    rnd, rows = random.Random(4), []
    for c in range(25):
        for i in range(rnd.choice((1, 2, 5, 60))):
            rows.append((c, i, "system" if i == 0 and c % 2 else rnd.choice(("user", "assistant")), " ".join("word" for _ in range(rnd.choice((0, 1, 8, 40))))))
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (99, None, None, None), (None, 0, "assistant", "a\\b <|end|>\n|> <"), (98, 0, "assistant", "long " * 20000), (98, 1, "a|>b", "<"), (97, 3, "user", "same"), (97, 3, "user", "same")]
    windows = chat.chat_windows(made(spark, rows), budget=100, history=30)
    assert got(chat.read_back(windows)) == brute(rows)
    own = defaultdict(list)
    for r in windows.collect():
        own[r["conv_id"]].append(r)
    assert max(map(len, own.values())) > 5
    for c, ws in own.items():
        ws.sort(key=lambda r: r["window"])
        assert [w["window"] for w in ws] == list(range(len(ws)))
        if c is not None and 0 <= c < 25 and c % 2:
            assert all(chat.turns_of(w["text"])[0][0] == "system" for w in ws)
        if c is not None and 0 <= c < 25:
            for w in ws:
                t = chat.turns_of(w["text"])
                assert sum(len(x.split()) + 4 for _, x in t) <= 100
                assert sum(len(x.split()) + 4 for _, x in t[:w["repeated"]]) <= 30 + 44
    assert chat.chat_windows(made(spark, [])).count() == 0 and chat.read_back(chat.chat_windows(made(spark, []))).count() == 0


@given(st.text(alphabet="<|>/s[]INT\\ a\n"))
def test_escape(text):
    assert chat.unescaped(chat.escaped(text)) == text and not chat._CONTROL.search(chat.escaped(text))


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.chat_windows(rows)).count() == 0
