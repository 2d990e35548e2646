"""Text columns: titles, slugs, tokens, versions, metric numbers, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of titles and words that don't tell one story from another.
TITLE_PREFIX = r"(?i)^(Show HN:|Ask HN:|GeekNews:|Hugging Face Blog:|GitHub - |\[GitHub\]|Release v?[0-9\.]+:?)\s*"
PLATFORM_PREFIX = r"(?i)^(?:News|Hacker News|Reddit|GeekNews|GitHub|HuggingFace Model|HF Space|PyTorchKR|YouTube(?:\s*\([^)]*\))?|Press(?:\s*\([^)]*\))?|r/[a-zA-Z0-9_]+):\s*"
VERSION = r"(?i)\b(?:b\d{4,6}|v?\d+\.\d+(?:\.\d+)?(?:-[a-z0-9.]+)?)\b"
RELEASE = r"\b(gemini|gpt|claude|deepseek|qwen|llama|glm|gemma|mistral|grok)[\s\-_]*(?:opus|sonnet|haiku|pro|flash|ultra|mini|v|r)?[\s\-_]*(\d+(?:\.\d+)?)\s*([a-z]{3,10})?\b"
NOT_CODENAMES = "model models with from into over after before under about between will can may now just more most other some such says said report reports launch launches launched release releases released announces announced unveils unveiled rolls out update updates for and the that this new open source free api app web chat code agent agents million billion context tokens users bench benchmark benchmarks".split()


SHOW_PREFIX = r"(?i)^(?:Show HN|Ask HN|Show GN):\s*"
# Rewrites before tokens are taken, in order.
SYNONYMS = [
    (r"\bsam altman\b|\baltman\b|\bopenai ceo\b|\bceo of openai\b", " openai altman "),
    (r"\bdario amodei\b|\bamodei\b|\banthropic ceo\b", " anthropic amodei "),
    (r"\bsundar pichai\b|\bdemis hassabis\b", " google "),
    (r"\bopen[\s\-]+weights?\b", " openweight "),
    (r"\bbad things\b|\bharms?\b|\brisks?\b", " risks "),
    (r"\bworth\b|\bbenefits?\b", " benefits "),
]
# Releases known by name, in order: every group has a word in the text, and no word of the last list is there.
RELEASES = [
    ("release:google-gemini-4-argon", [["gemini", "제미나이"], ["argon", "아르곤"]], []),
    ("release:openai-gpt-6-1-sol", [["gpt-6.1", "gpt 6.1"], ["sol"]], []),
    ("release:openai-gpt-6-astra", [["gpt-6"], ["astra"]], ["6.1"]),
    ("release:anthropic-claude-opus-5-5", [["claude", "클로드"], ["opus"], ["5.5"]], []),
    ("release:apple-mac-studio-m5-ultra", [["mac studio", "맥 스튜디오"], ["m5"], ["ultra"]], []),
    ("release:deepseek-v3-2-exp", [["deepseek"], ["v3.2"]], []),
    ("release:openai-dots-agent", [["openai", "오픈ai"], ["dots", "'dot'", " dot "], ["agent", "avatar", "에이전트", "智能体"]], []),
    ("release:meta-muse-ai-agent", [["meta", "메타"], ["muse"], ["agent", "personal", "openclaw", "imessage", "exploit", "filesystem", "amazon", "에이전트"]], []),
    ("release:f-droid-2-0", [["f-droid"], ["2.0"]], []),
    ("release:microsoft-copilot-plus-pc-dead", [["copilot+"], ["dead", "pull back"]], []),
    ("release:earendil-pi-1-0", [["pi 1.0", "pi durable"]], ["raspberry"]),
    ("release:germany-sovereign-ai-kolibri", [["kolibri"], ["sovereign", "open-weight", "open weight", "aleph-alpha", "tech report", "소버린", "오픈웨이트", "주권형", "기술 보고서"]], []),
    ("event:openai-altman-accept-ai-risks", [["altman", "알트만", "오픈ai 최고경영자", "openai ceo"], ["bad things", "accept some", "risks are worth", "warrant accepting", "일부 위험 감수", "나쁜 일도 받아들여야", "regulatory divide", "리스크 규제 입장", "부작용을 일으키겠지만"]], []),
]
# Words of one meaning, words that are left out, and the one phrase of two words.
ENTITY_WORDS = {
    "federal": "government", "fed": "government", "agencies": "government", "agency": "government", "websites": "sites", "website": "sites", "site": "sites", "portal": "sites", "portals": "sites", "bots": "agent", "bot": "agent", "agents": "agent", "crawler": "agent", "crawlers": "agent",
    "interacted": "access", "interact": "access", "breached": "access", "infiltrated": "access", "houthis": "houthi", "maritime": "shipping", "routes": "route", "seize": "control", "seized": "control", "islands": "island", "strategic": "key", "international": "global", "world": "global", "flocksafety": "flock",
    "filmed": "record", "tracked": "track", "surveillance": "track", "llama3": "llama", "qwen2": "qwen", "sonnet": "claude", "opus": "claude",
}
ENTITY_PHRASES = {"red sea": "redsea"}
ENTITY_STOP_WORDS = "hacker news geeknews the in of and to for on at by with from is a an as that this it".split() + "ai model models llm tool show ask hn new open source code paper release research using free data test system app web about how what why when into over after".split()
ENGLISH_PREFIX = r"(?i)^(?:news|hacker news|reddit|geeknews|lobsters|github|huggingface model|hf space|r/[a-zA-Z0-9_]+):\s*"
MODEL_PARTS = ["image", "coder", "vl", "vlm", "math", "distill", "turbo", "flash", "pro", "ultra"]


def clean_title(title: Column) -> Column:
    """Lower-case words of a title, without platform prefixes and marks."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_PREFIX, "")
    t = F.regexp_replace(t, r"[^a-zA-Z0-9가-힣\s]", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def slugify(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(t, r"(?U)[\s_-]+", "_"), 1, 45)


def story_key(text: Column) -> Column:
    """Up to four words of three letters or more, joined by hyphens."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " ")
    key = F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, 4), "-")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("tech-trend"))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(clean_title(title), " "), lambda w: w != ""))


def specific_tokens(text: Column, stop: list[str]) -> Column:
    """Distinct tokens of three characters or more that aren't stop words, in order."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9.\-+]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop)))


# Words that no title of a spike is told apart by, and names so broad that sharing them isn't specific.
SPIKE_STOP_WORDS = """
    the and for with that this from into over after before under about between through during without within along following
    across behind beyond plus except but up out around down off above near new how why what when where who will can may
    now just more most other some such no nor not only own same so than too very says said report reports launch launches
    launched release releases released announces announced unveils unveiled rolls update updates model models ai artificial intelligence
    tech technology company users system systems data first next open source youtube jocoding shorts reddit geeknews hacker news github arxiv
    press pytorchkr huggingface hugging face space video videos channel show ask has have are was were been being tells shows
    difference stance taking llm llms agent agents reasoning training design code coding paper papers preprint world features personal
    research blog technical changelog university peking tsinghua
    2025 2026 2027 jan feb mar apr may jun jul aug sep oct nov dec
    notable weekly daily build building guide using based via part large language
""".split()
BROAD_ENTITIES = "openai chatgpt anthropic claude google gemini meta llama microsoft copilot apple nvidia deepseek qwen amazon aws tesla github".split()


def spike_tokens(title: Column, platform: Column) -> Column:
    """Distinct tokens of a title, synonyms rewritten, that are neither stop words nor words of the platform's name."""
    own = F.split(F.regexp_replace(F.lower(F.coalesce(platform, F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_except(specific_tokens(with_synonyms(title, platform), SPIKE_STOP_WORDS), own)


def specific_of(shared: Column) -> Column:
    """Shared tokens without broad entities."""
    return F.array_except(shared, F.array(*map(F.lit, BROAD_ENTITIES)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if either has none."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def versions(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(VERSION), F.lit(0))
    return F.array_distinct(F.transform(found, lambda v: F.regexp_replace(v, "^v+", "")))


def version_conflict(a: Column, b: Column) -> Column:
    x, y = versions(a), versions(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def release_key(text: Column) -> Column:
    """family-version[-codename] of a release, '' without one. A whole number alone is too broad for a key."""
    t = F.lower(F.coalesce(text, F.lit("")))
    family, version, code = (F.regexp_extract(t, RELEASE, i) for i in (1, 2, 3))
    dashed = F.regexp_replace(version, r"\.", "-")
    named = (code != "") & ~code.isin(NOT_CODENAMES)
    key = F.concat(F.lit("release:auto-"), family, F.lit("-"), dashed)
    return F.when(family == "", "").when(named, F.concat(key, F.lit("-"), code)).when(dashed.contains("-"), key).otherwise("")


def metric_number(text: Column) -> Column:
    """15.4k is 15400; else the first number, commas left out; else 0."""
    thousands = F.regexp_extract(F.coalesce(text, F.lit("")), r"([\d\.]+)\s*[kK]", 1)
    plain = F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"([\d,]+)", 1), ",", "")
    return F.coalesce((thousands.try_cast("double") * 1000).cast("long"), plain.try_cast("long"), F.lit(0))


def html_text(html: Column) -> Column:
    """Text of HTML: scripts and styles out, block tags to line breaks, other tags out, entities of five marks read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/?p|/?div|/?li|/?h[1-6]|/?tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(mark))
    return t


def snippet(html: Column, n: int = 180) -> Column:
    return F.substring(F.trim(F.regexp_replace(html_text(html), r"\s+", " ")), 1, n)


# Names that give an entity key, in order.
ENTITY_PATTERNS = [
    r"\b(qwen[-_ ]?image[-_ ]?2\.?1)\b",
    r"\b(jev)\b",
    r"\b(deepseek[-_ ]?[rv]\d+[\w\.-]*)\b",
    r"\b(llama[-_ ]?\d+[\w\.-]*)\b",
    r"\b(glm[-_ ]?\d+[\w\.-]*)\b",
    r"\b(flux[-_ ]?\d+[\w\.-]*)\b",
    r"\b(flash[-_ ]?attn[-_ ]?\d*)\b",
    r"\b(bespoke[-_ ]?nimble[-_ ]?\d+b?)\b",
    r"\b(confucius\d+[-_ ]?r\d+t\d+)\b",
    r"\b([a-z0-9]+-[a-z0-9]+(?:-\d+[\w\.-]*)?)\b",
]
ENTITY_PREFIX = r"(?i)^(?:github:\s*|huggingface:\s*|hf space:\s*|hacker news:\s*|arxiv:\s*|geeknews:\s*|pytorchkr:\s*|show hn:\s*)"
ENTITY_STOP = ["출시", "공개", "발표", "오픈소스", "모델"]


def entity_key(title: Column, url: Column) -> Column:
    """Repository of a code URL, else a known name, else the first word of the title, else its start as a slug."""
    everything = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    repository = F.nullif(F.regexp_replace(F.regexp_extract(everything, r"github\.com/([\w\.-]+/[\w\.-]+)", 1), r"\.git$", ""), F.lit(""))
    names = []
    for pattern in ENTITY_PATTERNS:
        key = F.trim(F.regexp_replace(F.regexp_extract(everything, pattern, 1), "[-_ ]+", "-"), F.lit("-"))
        names.append(F.when(F.length(key) >= 3, key))
    word = F.trim(F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(title, F.lit("")), ENTITY_PREFIX, ""), r"[a-zA-Z0-9가-힣\.-]{3,}", 0)), F.lit(".-"))
    first = F.when((F.length(word) >= 3) & ~word.rlike("^[0-9]+$") & ~word.isin(ENTITY_STOP), word)
    return F.coalesce(repository, *names, first, F.replace(F.trim(F.substring(clean_title(title), 1, 25)), F.lit(" "), F.lit("-")))


def similar_story_keys(a: Column, b: Column) -> Column:
    """Equal, or three tokens each, three in common, and half of the smaller set."""
    x, y = (F.array_distinct(F.filter(F.split(k, "-"), lambda w: w != "")) for k in (a, b))
    both = F.size(F.array_intersect(x, y))
    return (a == b) | ((F.size(x) >= 3) & (F.size(y) >= 3) & (both >= 3) & (both >= 0.5 * F.least(F.size(x), F.size(y))))


def search_key(title: Column) -> Column:
    """What stands before a dash, colon or bracket, without a platform prefix; else the first 35 characters."""
    plain = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^(?:GitHub:|HuggingFace:|HF Space:|Hacker News:|ArXiv:|GeekNews:|Paper:)\s*", ""))
    head = F.trim(F.element_at(F.split(plain, r"\s+-\s+|\s*[:：]\s*|\s*[\(（【]"), 1))
    return F.when((F.length(head) >= 3) & (head.contains("/") | (F.length(head) <= 40)), head).otherwise(F.trim(F.substring(plain, 1, 35)))


def key_of(text: Column, n: int = 100) -> Column:
    """Letters, digits and single hyphens, at most n."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, n)


def embedding_text(title: Column, hook: Column, summary: Column) -> Column:
    """What is embedded of an item; parts that are missing are left out."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return F.concat_ws(" | ", part("", title), part("Hook: ", hook), part("Summary: ", F.substring(summary, 1, 300)))


def translated(text: Column, words: dict[str, str]) -> Column:
    """Whole words of a dictionary replaced, in its order."""
    for word, by in words.items():
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", by)
    return text


def without_platform(text: Column, platform: Column | None = None) -> Column:
    """A title without the name of its platform, of a known platform, or of a kind of forum post before it."""
    s = F.trim(F.coalesce(text, F.lit("")))
    if platform is not None:
        for name in (F.trim(platform), F.trim(F.substring_index(platform, "(", 1))):
            led = (F.coalesce(name, F.lit("")) != "") & F.startswith(F.lower(s), F.concat(F.lower(name), F.lit(":")))
            s = F.when(led, F.trim(F.substr(s, F.length(name) + 2))).otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, PLATFORM_PREFIX, ""), SHOW_PREFIX, "")


def with_synonyms(text: Column, platform: Column | None = None) -> Column:
    s = F.lower(without_platform(text, platform))
    for pattern, by in SYNONYMS:
        s = F.regexp_replace(s, pattern, by)
    return s


def release_cluster_key(text: Column) -> Column:
    """A release known by name, else what release_key() reads."""
    t = F.lower(F.coalesce(text, F.lit("")))

    def any_word(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | t.contains(w)
        return out

    out = None
    for key, groups, without in RELEASES:
        hit = ~any_word(without)
        for words in groups:
            hit = hit & any_word(words)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out.otherwise(release_key(text))


def english_title(title_en: Column, title: Column) -> Column:
    raw = F.coalesce(F.nullif(title_en, F.lit("")), title, F.lit(""))
    plain = F.trim(F.regexp_replace(raw, ENGLISH_PREFIX, ""))
    return F.coalesce(F.nullif(plain, F.lit("")), raw)


def entity_tokens(text: Column) -> Column:
    """Sorted distinct words of ASCII letters and digits, each by its one meaning, without what tells no story."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for phrase, by in ENTITY_PHRASES.items():
        t = F.replace(t, F.lit(phrase), F.lit(f" {by} "))
    meaning = F.create_map(*[F.lit(x) for kv in ENTITY_WORDS.items() for x in kv])
    words = F.transform(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.coalesce(F.element_at(meaning, w), w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(ENTITY_STOP_WORDS))))


#: Words that English titles are compared without.
ENGLISH_STOP_WORDS = "the a an and or in on at by for with from is are was were to of it its that this how what why when into over after via vs new using use".split()


def english_tokens(title: Column) -> Column:
    """Sorted distinct words of a title as they are written, hyphens, dots and underscores within, of two characters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[a-z0-9_\-.]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(ENGLISH_STOP_WORDS))))


def is_specific_entity(entity: Column) -> Column:
    """A name with a digit, or with a hyphen and a part that tells variants apart."""
    parts = F.split(F.coalesce(entity, F.lit("")), "-")
    return F.coalesce(entity, F.lit("")).rlike("[0-9]") | ((F.size(parts) >= 2) & F.exists(parts, lambda p: p.isin(MODEL_PARTS)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def first_sentence(body: Column, otherwise: Column, least: int = 15, most: int = 160) -> Column:
    """The first sentence of more than `least` characters, else `otherwise`; a longer one than `most` ends in three dots."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s).*?[.!?\n]\s+|.+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^[ \n\t]+|[ \n\t]+$", ""))
    first = F.coalesce(F.get(F.filter(parts, lambda x: F.length(x) > least), F.lit(0)), otherwise)
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def keywords(title: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(title, F.lit("[A-Za-z0-9_-]{3,}"), F.lit(0)), 1, n), ",")


BOILERPLATE_HOOK = r"(?i)^Key architectural updates and practitioner impact analysis published via"


def embedding_text_plain(title: Column, hook: Column, summary: Column | None = None) -> Column:
    """What is embedded without a cut; with title and hook only where there is no summary column."""
    part = lambda label, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(label), F.trim(c)))
    return F.concat_ws(" | ", part("", title), part("Hook: ", hook), *([part("Summary: ", summary)] if summary is not None else []))


def embedding_text_guarded(title: Column, hook: Column, summary: Column) -> Column:
    """What the worker embeds: the title without its platform, no boilerplate, 300 characters of the summary."""
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    kept = lambda c: F.when(plain(c).rlike(BOILERPLATE_HOOK), "").otherwise(plain(c))
    head = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), PLATFORM_PREFIX, ""))
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    return F.concat_ws(" | ", F.coalesce(F.nullif(head, F.lit("")), F.lit("Untitled")), part("Hook: ", kept(hook)), part("Summary: ", F.substring(kept(summary), 1, 300)))
