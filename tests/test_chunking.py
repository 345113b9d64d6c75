import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions.chunking import ChunkOptions, _sentence_groups, _windows, chunk_text
from textquarry.functions.text import normalize_whitespace, sentences


def chunks(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(chunk_text(F.col("t"), ChunkOptions(**options)).alias("c")).first()["c"]


def by_the_rule(text, size, overlap, least):
    """The window rule, cut out of the text index by index."""
    text = " ".join(text.split())
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            spaces = [i for i in range(at + 1, end) if text[i] == " "]
            end = spaces[-1] if spaces else end
        if len(text[at:end].strip()) >= least:
            out.append(text[at:end].strip())
        at = end - overlap if end - overlap > at else at + max(1, size - overlap)
    return out


@pytest.mark.parametrize("text", ["", "   \n\t "])
def test_blank_text_has_no_chunks(spark, text):
    assert chunks(spark, text) == []
    assert chunks(spark, text, mode="sentence") == []


def test_short_text_is_one_chunk(spark):
    assert chunks(spark, "hello   \n\n  world", min_chunk_size=1) == ["hello world"]


def test_long_text_without_spaces(spark):
    got = chunks(spark, "a" * 1200)
    assert [len(c) for c in got] == [1000, 400]


def test_tail_is_emitted_again(spark):
    assert [len(c) for c in chunks(spark, "x" * 950)] == [950, 150]


def test_windows_end_at_words_and_overlap(spark):
    got = chunks(spark, "word " * 200, chunk_size=100, overlap=20, min_chunk_size=1)
    assert len(got) > 2
    assert all(len(c) <= 100 and c.endswith("word") for c in got)
    # The last window is the tail of the one before it, emitted again, and may be shorter than the overlap.
    assert all(a[-15:] in b for a, b in zip(got[:-2], got[1:-1]))


def test_short_windows_are_dropped(spark):
    assert chunks(spark, "a" * 100 + " b", chunk_size=100, overlap=0, min_chunk_size=50) == ["a" * 100]


def test_unicode_blanks_count_as_white_space(spark):
    text = "one\u00a0two\u2003three\x1cfour"
    assert chunks(spark, text, min_chunk_size=1) == ["one two three four"]
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalize_whitespace(F.col("t"))).first()[0] == "one two three four"


@pytest.mark.parametrize(
    "options", [{"chunk_size": 100, "overlap": 100}, {"mode": "page"}, {"chunk_size": 0}, {"min_chunk_size": 0}]
)
def test_bad_options(options):
    with pytest.raises(ValueError):
        ChunkOptions(**options)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(
    st.text(alphabet="ab .\n\u00a0é", max_size=300),
    st.integers(1, 40),
    st.integers(0, 39),
    st.integers(1, 12),
)
def test_windows_follow_the_rule(text, size, overlap, least):
    if overlap >= size:
        return
    opts = ChunkOptions(size, overlap, least)
    assert list(_windows(" ".join(text.split()), opts)) == by_the_rule(text, size, overlap, least)


def test_sentences_stay_whole(spark):
    text = "First sentence here. Second one follows! Does a third come?\n\nA new paragraph begins. It ends."
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sentences(F.col("t"))).first()[0] == [
        "First sentence here.",
        "Second one follows!",
        "Does a third come?",
        "A new paragraph begins.",
        "It ends.",
    ]
    got = chunks(spark, text, mode="sentence", chunk_size=45, overlap=0, min_chunk_size=1)
    assert got == ["First sentence here. Second one follows!", "Does a third come? A new paragraph begins.", "It ends."]


def test_sentence_overlap_carries_the_tail():
    opts = ChunkOptions(12, 6, 1, "sentence")
    assert list(_sentence_groups(["aaaa.", "bbbb.", "cccc."], opts)) == ["aaaa. bbbb.", "bbbb. cccc."]


def test_long_sentence_is_cut_by_words():
    opts = ChunkOptions(20, 5, 1, "sentence")
    long = "word " * 12
    got = list(_sentence_groups(["short one.", long.strip(), "end."], opts))
    assert got[0] == "short one." and got[-1] == "end."
    assert got[1:-1] == by_the_rule(long, 20, 5, 1)
