import pytest
from pyspark.sql import functions as F

from tallyworks.functions import classify, payload, rules, scoring, text, timeslot, url, vector
from tallyworks.operators import similarity


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


CASES = [
    (lambda x: url.canonical(x), "http://www.A.com/x/?utm_source=1&b=2&a=1#f", "https://a.com/x?a=1&b=2"),
    (lambda x: url.canonical(x), "https://a.com/?reference=1", "https://a.com"),
    (lambda x: url.canonical(x), None, ""),
    (lambda x: url.bare(x), "HTTPS://www.Example.com/Path/", "example.com/path"),
    (lambda x: url.without_tracking(x), "https://a.com/p?b=2&utm_id=3&a=1#frag", "https://a.com/p?b=2&a=1#frag"),
    (lambda x: url.without_tracking(x, "chatgpt"), "https://a.com/?from_chatgpt=1", "https://a.com/"),
    (lambda x: text.metric_number(x), "★ 1,234 Stars", 1234),
    (lambda x: text.metric_number(x), "15.4k", 15400),
    (lambda x: text.metric_number(x), "", 0),
    (lambda x: text.metric_number(x), "no digits", 0),
    (lambda x: text.slugify(x), "Hello,  World - A_B", "hello_world_a_b"),
    (lambda x: text.clean_title(x), "Show HN: Foo-Bar 2.1!", "foo bar 2 1"),
    (lambda x: text.release_key(x), "Qwen 3.5 released", "release:auto-qwen-3-5"),
    (lambda x: text.release_key(x), "GPT-4 news", "release:auto-gpt-4-news"),
    (lambda x: text.release_key(x), "GPT-4 released", ""),
    (lambda x: text.release_key(x), "Claude 9.9 zephyr", "release:auto-claude-9-9-zephyr"),
    (lambda x: text.story_key(x), "a big: Story, told in four parts", "big-story-told-four"),
    (lambda x: text.story_key(x), "a b", "tech-trend"),
    (lambda x: text.entity_key(F.lit("t"), x), "https://github.com/Own/Repo.git", "own/repo"),
    (lambda x: text.entity_key(x, F.lit("")), "New Llama 3.1 weights", "llama-3.1"),
    (lambda x: text.entity_key(x, F.lit("")), "Show HN: Zig tools", "zig"),
    (lambda x: text.search_key(x), "GitHub: own/repo - a thing", "own/repo"),
    (lambda x: text.key_of(x), "A -- b_c!", "a-b-c"),
    (lambda x: text.embedding_text(x, F.lit(None).cast("string"), F.lit("s")), "t", "t | Summary: s"),
    (lambda x: text.translated(x, {"cat": "dog"}), "Cat catalog", "dog catalog"),
    (lambda x: text.similar_story_keys(x, F.lit("b-c-d-e")), "a-b-c-d", True),
    (lambda x: text.similar_story_keys(x, F.lit("b-c")), "a-b-c", False),
    (lambda x: rules.valid_candidate(x), "https://github.com", False),
    (lambda x: rules.valid_candidate(x), "https://github.com/a/b", True),
    (lambda x: rules.valid_candidate(x), "https://news.ycombinator.com/item?id=x", False),
    (lambda x: rules.model_family(x), "unsloth/Qwen2.5-Coder_GGUF", "Qwen-2.5-Coder Family"),
    (lambda x: rules.model_family(x), "Qwen-2.5 Coder", "Qwen-2.5-Coder Family"),
    (lambda x: rules.variant_role(x), "llama base gguf", rules.ROLE_RULES[3][1]),
    (lambda x: rules.story_entity(F.lit("none"), x), "big-story-github-repo", "big-story"),
    (lambda x: rules.canonical_platform(x, F.lit("https://hada.io/1")), "blog", "geeknews"),
    (lambda x: payload.has_key(x, "a"), '{"a": null}', True),
    (lambda x: payload.array_length(x, "a"), '{"a": {}}', 0),
    (lambda x: payload.path(x, "a", "b"), '{"a": "", "b": "y"}', "y"),
    (lambda x: payload.without_fields(x, ["a"]), '{"a": 1, "b": {"c": [1, true]}}', '{"b":{"c":[1,true]}}'),
    (lambda x: payload.with_fields(x, {"n": F.lit(3), "s": F.lit("t")}), '{"a": {"b": 2}, "n": "old"}', '{"a":{"b":2},"n":3,"s":"t"}'),
    (lambda x: payload.without_keys(x, ["drop"]), '{"a": {"drop": 1, "k": [{"drop": 2, "z": 1}]}, "drop": 3}', '{"a":{"k":[{"z":1}]}}'),
    (lambda x: payload.repaired(x), 'Sure: ```json\n[{"a": 1, "b": "c', '[{"a": 1, "b": "c"}]'),
    (lambda x: payload.repaired(x), '<think>x</think>{"a": [1, 2', '[{"a": [1, 2]}]'),
    (lambda x: payload.repaired(x), "no json", None),
    (lambda x: text.snippet(x), "<p>a&amp;b</p><script>x</script><b>c</b>", "a&b c"),
    (lambda x: classify.language(x), "한글", "KO"),
    (lambda x: classify.language(x), "ひらがな", "JA"),
    (lambda x: classify.language(x), "漢字", "ZH"),
    (lambda x: classify.language(x), "abc", "EN"),
    (lambda x: classify.source_axis(x, F.lit(None).cast("string")), "The Hacker News", "PRESS"),
    (lambda x: classify.source_axis(x, F.lit("")), "Hacker News", "COMMUNITY"),
    (lambda x: classify.source_axis(F.lit("blog"), x), "https://discuss.pytorch.kr/t/1", "COMMUNITY"),
    (lambda x: classify.source_axis(F.lit("blog"), x), "https://arxiv.org/abs/1", "CODE"),
    (lambda x: classify.platform_family(x), "Hugging Face", "HuggingFace"),
    (lambda x: timeslot.slot(x.cast("timestamp_ntz")), "2024-01-01 14:59:00", 18),
    (lambda x: timeslot.slot(x.cast("timestamp_ntz")), "2024-01-01 15:00:00", 0),
    (lambda x: timeslot.slot(x.cast("timestamp_ntz")), "2024-01-01 21:00:00", 6),
    (lambda x: timeslot.case_date(x).cast("string"), "2026-09-17_some_case", "2026-09-17"),
    (lambda x: timeslot.case_date(x), "no date", None),
    (lambda x: timeslot.parsed(x, timeslot.RFC_822, F.lit(None).cast("timestamp")).cast("string"), "Tue, 02 Jan 2024 03:04:05 +0000", "2024-01-02 03:04:05"),
    (lambda x: timeslot.parsed(x, timeslot.RFC_822, F.lit(None).cast("timestamp")), "bad", None),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalars(value, case):
    make, given, expect = CASES[case]
    assert value(make(F.lit(given).cast("string"))) == expect


def test_versions_and_similarity(value):
    conflict = lambda a, b: value(text.version_conflict(F.lit(a), F.lit(b)))
    assert conflict("x b11397", "x b11411") and not conflict("x 1.2", "x v1.2") and not conflict("x", "x 1.2")
    jac = lambda a, b: value(text.jaccard(text.title_tokens(F.lit(a)), text.title_tokens(F.lit(b))))
    assert jac("a b c", "b c d") == 0.5 and jac("", "a") == 0.0
    vec = lambda a: F.array(*[F.lit(float(x)) for x in a])
    cos = lambda a, b: value(vector.cosine(vec(a), vec(b)))
    assert cos((1, 0), (1, 0)) == 1.0 and cos((1, 0), (0, 1)) == 0.0 and cos((1,), (1, 0)) == 0.0 and cos((0, 0), (1, 0)) == 0.0


@pytest.mark.parametrize(("n", "axes", "platforms", "age", "score", "spiking"), [(1, 1, 1, 1, 9.8, False), (2, 2, 2, 4, 23.1, True), (3, 3, 3, 36, 12.5, True), (2, 1, 1, 1, 19.6, False), (2, 2, 2, 0.1, 49.5, True)])
def test_spike_vectors(value, n, axes, platforms, age, score, spiking):
    hours = F.greatest(F.lit(float(age)), F.lit(0.5))
    s = scoring.spike(F.lit(n), F.lit(axes), F.lit(platforms), hours, F.lit(0), F.lit(0), F.lit(0))
    assert value(s["score"]) == score and value(s["is_spiking"]) == spiking


def test_hype_risk_adds_up(value):
    risk = lambda t, stars=0, n=99: value(scoring.hype_risk(F.lit(t), F.lit("GitHub Official"), F.lit(stars), F.lit(n)))
    assert risk("plain") == 15 and risk("it beats o1 and is passive income") == 90 and risk("x", 5000, 10) == 40
    assert risk("open source under a business license") == 35 and risk("kills openai passive income open source non-commercial", 5000, 1) == 100


def test_sources_heal_and_merge(spark):
    mine = '{"sources": [{"platform": "YouTube (C)", "url": "https://youtu.be/2"}, {"platform": "Press", "url": "https://p/1"}]}'
    healed = payload.healed_sources(F.lit(mine), F.lit("YouTube (C)"), F.lit("https://youtu.be/1"), F.lit("t"), F.lit("2024-01-01"))
    theirs = payload.sources(F.lit('{"sources": [{"platform": "GitHub", "url": "https://github.com/a/b"}, {"platform": "GitHub", "url": "https://github.com/a/c"}, {"platform": "x", "url": "https://p/1"}]}'))
    r = spark.range(1).select(healed.alias("h"), payload.merged_sources(healed, theirs).alias("m")).first()
    assert [s.url for s in r.h] == ["https://youtu.be/1", "https://p/1"]
    assert [s.url for s in r.m] == ["https://youtu.be/1", "https://p/1", "https://github.com/a/b"]


def test_spike_tokens_and_their_veto(spark):
    rows = [("Reddit: Sam Altman says open weights ship via vLLM 0.9", "Reddit r/LocalLLaMA", "Claude and Gemini benefits"), ("Press: Google unveils the vLLM-fork", "Press (Reuters)", "OpenAI buys metal"), (None, None, None)]
    df = spark.createDataFrame(rows, "title string, platform string, other string")
    out = df.select(text.spike_tokens(F.col("title"), F.col("platform")).alias("x"), text.specific_of(F.array(F.lit("openai"), F.lit("vllm"))).alias("s"), similarity.no_common_entity(text.with_synonyms(F.col("title")), text.with_synonyms(F.col("other"))).alias("veto")).collect()
    assert out[0].x == ["openai", "altman", "openweight", "ship", "vllm", "0.9"] and out[0].s == ["vllm"]
    assert out[1].x == ["google", "vllm-fork"] and out[2].x == []
    assert [r.veto for r in out] == [False, True, False]  # one side without names; google against openai and meta(l)


def test_parsed_payload_reads_like_the_text(spark):
    texts = ['{"a":"x","b":{"c":1},"sources":[{"url":"u","platform":"p"}],"f":true}', '{"a":"","sources":"none"}', "broken", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, p string")
    read = df.withColumn("j", F.from_json("p", f"a string, b struct<c:string>, f string, sources {payload.SOURCES.simpleString()}"))
    j = payload.Parsed(F.col("j"))
    for one, two in ((payload.path(F.col("p"), "b.c", "a"), payload.path(j, "b.c", "a")), (payload.get(F.col("p"), "f"), payload.get(j, "f")), (payload.sources(F.col("p")), payload.sources(j))):
        assert all(r.one == r.two for r in read.select(one.alias("one"), two.alias("two")).collect())
