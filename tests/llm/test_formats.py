"""WARC archives and chat windows: exact round trips."""

import gzip
import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.plain import sha
from voxloom.llm import chat, queries, warc

BIG = "x" * 50 + "é" * 25
PAGES = [(5, "http://a/%\r\nWARC-Type: evil", BIG), (3, None, BIG), (9, "u", BIG), (3, "again", BIG), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""),
         (7, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb" * 9), (None, "u", "y" * 200), (None, "u", "y" * 200), (None, "u", BIG), (8, "u", "\0" * 120 + "😀")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, n long, digest string")


def plain(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in rows:
        html = html or ""
        again = len(html.encode()) >= 100 and html in first and i != first[html]
        yield i, len(html.encode()), sha(html), "revisit" if again else "response", first[html] if again else None


def test_archive_round_trip(spark, pages):
    assert Counter(tuple(r) for r in warc.archived(pages).collect()) == Counter(plain(PAGES))
    table = spark.read.parquet(f"{SF}/pages.parquet")
    assert Counter(tuple(r) for r in warc.archived(table).collect()) == Counter(plain([(r.page_id, r.url, r.html) for r in table.collect()]))
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", None])
def test_archive_files(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write(pages, path, compression)
    got = warc.read(spark, path)
    rows = got.collect()
    assert len(rows) == len(PAGES) and {r.warc_date for r in rows} == {warc.DATE}
    urls = got.where("record_id = 'urn:page:5'").select(warc.unescaped(F.col("target_uri"))).first()
    assert urls[0] == PAGES[0][1]
    html = {r.record_id: bytes(r.payload).decode() for r in rows if r.record_type == "response"}
    assert html["urn:page:7"] == PAGES[8][2] and html["urn:page:8"] == PAGES[12][2]
    few = warc.read(spark, path, "record_id string, record_type string").where("record_type = 'revisit'")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan  # the predicate is the reader's work
    assert {r.record_id for r in few.collect()} == {"urn:page:5", "urn:page:9", "urn:page:"}
    for f in tmp_path.glob("w/part-*"):
        raw = gzip.decompress(f.read_bytes()) if compression else f.read_bytes()
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_reader_skips_unwanted_payloads(spark, pages, tmp_path):
    path = f"{tmp_path}/w"
    warc.write(pages, path, None)
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import StringType, StructType

    reader = warc.WarcReader(StructType().add("record_id", StringType()), {"path": path, "partition_bytes": "1"})
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload",), b"")])) == [EqualTo(("payload",), b"")]
    parts = reader.partitions()
    assert sum(len(p.paths) for p in parts) == len(parts)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 3
    with pytest.raises(ValueError):
        warc.WarcReader(StructType().add("nonsense", StringType()), {"path": path})


TALK = [(1, 0, "system", "be <|end|> kind"), (1, 1, "user", "a\nb [INST] <s>"), (1, 2, "assistant", "<\\|turn|> \\ <|turn|>assistant\nno<|end|>\n"), (1, 2, "assistant", ""), (2, 0, "a\nb\\n<|", None), (2, None, None, "first"), (None, 1, "assistant", "x"), (None, 0, "user", "y")]
LONG = [(7, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * (i % 50)) for i in range(300)] + [(8, 0, "system", "s " * 50), (8, 1, "assistant", "w " * 3000), (8, 2, "assistant", "end")]


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [t[3] or "" for t in turns if t[2] == "assistant"]
        yield conv, len(turns), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)), sum(map(len, said)), sha("".join(said))


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 20), (1, 1000)])
def test_chat_round_trip(spark, budget, history):
    rows = TALK + LONG
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = chat.round_trip(df, budget, history).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected(rows))
    windows = chat.formatted(df, budget, history).collect()
    for w in windows:
        turns = chat.parsed(w.text)
        cost = [len(t.split()) + chat.MARKS for _, t in turns]
        assert sum(cost) <= budget or len(turns) - w.n_repeated == 1
        assert w.conv_id != 8 or turns[0][0] == "system"
    assert sum(r.formatted_chars for r in got) == sum(len(w.text) for w in windows)


def test_ten_thousand_turns(spark):
    """One conversation: every window is filled, as a loop over all turns fills it."""
    turns = [(1, i, "system" if i == 0 else "user" if i % 2 else "assistant", "w " * (i * 7 % 23)) for i in range(10_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    windows = sorted(chat.formatted(df, 1024, 512).collect(), key=lambda w: w.window)
    tokens = [len(t.split()) + chat.MARKS for *_, t in turns]
    at, shown = 0, []
    while at < len(turns):
        spent, back = (tokens[0] if at else 0), []
        for k in range(at - 1, 0, -1):
            if sum(tokens[b] for b in back) + tokens[k] > min(512, 1024 - spent - tokens[at]):
                break
            back.insert(0, k)
        spent += sum(tokens[b] for b in back)
        end = at
        while end < len(turns) and (end == at or spent + tokens[end] <= 1024):
            spent += tokens[end]
            end += 1
        shown.append(([0] if at else []) + back + list(range(at, end)))
        at = end
    assert [[(r, t) for r, t in chat.parsed(w.text)] for w in windows] == [[turns[k][2:] for k in ks] for ks in shown]
    assert max(len(ks) for ks in shown) > 64
    assert Counter(tuple(r)[:5] for r in chat.round_trip(df, 1024, 512).collect()) == Counter(expected(turns))


def test_chat_sql(spark):
    import duckdb

    want = duckdb.sql(chat.SQL.replace("FROM conversations", f"FROM '{SF}/conversations.parquet'")).fetchall()
    assert Counter(tuple(r) for r in queries.op8_chat(spark, SF).collect()) == Counter(want)


def test_chat_query(spark):
    got = queries.op8_chat(spark, SF).collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]))


def test_history_is_repeated_but_no_target(spark):
    df = spark.createDataFrame(LONG[:40], "conv_id long, turn long, role string, text string")
    windows = sorted(chat.formatted(df, 100, 40).collect(), key=lambda w: w.window)
    assert any(w.n_repeated for w in windows[1:])
    masked = [w.text[s.start : s.end] for w in windows for s in w.loss]
    assert masked == [t for _, _, role, t in LONG[:40] if role == "assistant"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<|\\s>/[INST]\nturn end", max_size=30), st.text(alphabet="<|\\s>/[INST]\nturn|end😀", max_size=60)), max_size=5))
def test_escapes(turns):
    window = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert chat.parsed(window) == turns
    assert all(not chat.CONTROL.search(chat.escaped(t)) or "\\" in chat.escaped(t) for _, t in turns)


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.round_trip(none).count() == 0
    assert hashlib.sha256(b"").hexdigest() == sha("")
