"""Four more rule sets for the primary category, and what hangs on them: artifact types, entities, news, credibility. Rules are data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import any_of, first_match

# By category, in order, words that stand in the text as whole words; (a, b): one of a and one of b.
ENRICH_WORDS = [
    ("CIVIC_CRIME_INCIDENT", ["governor candidate", "armed man", "attacks", "injuries reported", "police", "shooting", "suspect arrested", "murder", "assault", "gubernatorial", "주지사 후보", "피습", "무장 남성", "부상자", "총격", "경찰 수사", "체포", "선거 유세"], []),
    ("HISTORY_LIFE_CULTURE", ["stew with beets", "recipe", "ancient recipe", "babylonian", "cooking", "cookbook", "archaeology", "medieval manuscript", "ancient roman", "고대 요리", "스튜 레시피", "바빌로니아", "고고학", "역사 문헌", "중세 필사본", "인문학"], []),
    ("DEEP_SCIENCE_SPACE", ["aerospace", "rocket", "orbit", "orbital", "satellite", "spacecraft", "nasa", "esa", "astronomy", "astronomer", "telescope", "dark matter", "diamond mine", "lab-grown diamond", "superconductor", "nuclear fusion", "우주", "항공우주", "발사체", "로켓", "궤도 진입", "궤도 발사", "인공위성", "천문", "암흑물질", "다이아몬드 광산", "핵융합", "초전도체", "신소재"], [(["space", "launch", "mission"], ["orbit", "rocket", "payload", "cosmos", "satellite", "궤도", "발사체"])]),
    ("MACRO_GLOBAL_BIZ", ["gold reserve", "central bank", "monetary policy", "inflation", "interest rate", "macroeconomics", "gdp growth", "treasury", "tariff", "antitrust", "ftc", "금 86톤", "금 회수", "중앙은행", "통화 정책", "인플레이션", "기준금리", "거시경제", "재정 건전성", "관세", "반독점", "독점 판결", "정부 부패"], [(["gold", "금"], ["reserve", "bullion", "central bank", "회수", "보관", "중앙은행", "온스", "ton"])]),
    ("INFERENCE_OPT", ["gguf", "vllm", "sglang", "ollama", "awq", "fp8", "int4", "int8", "kv cache", "speculative decoding", "inference", "serving", "quantization", "latency", "추론", "서빙", "양자화", "경량화", "가속"], []),
    ("MULTIMODAL_AI", ["vlm", "diffusion", "tts", "stt", "whisper", "flux", "wan", "minimax", "sora", "kling", "runway", "stable diffusion", "text-to-image", "text-to-video", "multimodal", "멀티모달", "음성합성", "영상 생성", "화상 생성"], [(["video", "vision", "speech", "audio", "voice", "sound", "image", "음성", "비디오", "영상", "이미지"], ["ai", "model", "neural", "deep learning", "인공지능", "모델", "생성"])]),
    ("AGENTS_DEVTOOLS", ["agent", "agents", "browser use", "scraping", "crawler", "devtools", "copilot", "automation", "cli", "framework", "sdk", "에이전트", "자동화", "개발도구", "코딩", "프레임워크"], []),
    ("INFRA_RAG_SECURITY", ["rag", "vectordb", "vector database", "embedding", "embeddings", "jailbreak", "cve", "vulnerability", "benchmark", "evaluation", "eval", "mlops", "cluster", "탈옥", "취약점", "임베딩", "평가"], [(["security", "보안"], ["linux", "kernel", "exploit", "bypass", "patch", "zero-day", "악성코드", "취약점", "우회"])]),
    ("FOUNDATION_MODELS", ["weights", "safetensors", "checkpoint", "lora", "foundation model", "pretrained", "파운데이션", "가중치", "체크포인트", "qwen", "deepseek", "llama", "mistral", "gemma"], []),
]
# Words that stand anywhere in the text, in order.
BULK_WORDS = [
    ("INFERENCE_OPT", ["quant", "vllm", "inference", "sglang", "tensorrt", "fp8", "int4", "cuda"]),
    ("AGENTS_DEVTOOLS", ["agent", "workflow", "mcp", "copilot", "coding", "ide", "langchain"]),
    ("MULTIMODAL_AI", ["vision", "diffusion", "multimodal", "image", "video", "audio", "whisper", "flux"]),
    ("CIVIC_CRIME_INCIDENT", ["law", "court", "trial", "judge", "lawsuit", "crime", "police", "arrest", "prison"]),
    ("MACRO_GLOBAL_BIZ", ["market", "stock", "invest", "fund", "nasdaq", "tariff", "revenue", "economy"]),
    ("DEEP_SCIENCE_SPACE", ["space", "nasa", "astronomy", "biology", "genome", "crispr", "quantum", "physics"]),
    ("INFRA_RAG_SECURITY", ["rag", "vector", "database", "postgres", "security", "auth", "hack", "firewall"]),
]
REPEAT_WORDS = [
    ("CIVIC_CRIME_INCIDENT", ["court", "law", "sue", "patent", "ban", "antitrust", "sec", "doj", "fcc", "legal", "crime", "election", "소송", "판결", "특허", "규제", "범죄", "선거"]),
    ("MACRO_GLOBAL_BIZ", ["market", "stock", "fund", "invest", "revenue", "ipo", "dollar", "price", "pricing", "주가", "투자", "매출", "상장", "환율", "요금", "가격"]),
    ("DEEP_SCIENCE_SPACE", ["arxiv", "paper", "preprint", "theorem", "physics", "quantum", "biology", "math", "brain", "논문", "연구", "양자", "수학"]),
    ("AGENTS_DEVTOOLS", ["agent", "benchmark", "eval", "devday", "tool", "sdk", "api", "framework", "mcp", "terminal", "에이전트", "프레임워크", "도구"]),
    ("FOUNDATION_MODELS", ["model", "llm", "transformer", "reasoning", "weights", "checkpoint", "gemma", "qwen", "모델"]),
    ("INFRA_RAG_SECURITY", ["security", "exploit", "vulnerability", "hacker", "infra", "cloud", "server", "보안", "해킹", "취약점", "서버", "인프라"]),
]
#: The batch variant of REPEAT_WORDS knows some more words. Fixed values.
BATCH_MORE = {"CIVIC_CRIME_INCIDENT": ["대통령"], "MACRO_GLOBAL_BIZ": ["비용"]}
REPEAT_TYPES = {"CIVIC_CRIME_INCIDENT": "NEWS", "MACRO_GLOBAL_BIZ": "NEWS", "DEEP_SCIENCE_SPACE": "TECH", "FOUNDATION_MODELS": "MODEL", "INFRA_RAG_SECURITY": "TECH", "INDUSTRY_TRENDS": "NEWS"}
KNOWN_ENTITIES = ["openai", "chatgpt", "claude", "anthropic", "gemini", "google", "meta", "llama", "apple", "microsoft", "copilot", "nvidia", "deepseek", "tesla", "linux", "unix", "rust", "python", "wayland", "vllm", "mcp", "pytorch", "hugging face", "arxiv"]
BULK_PRESS = ["press", "news", "reuters", "bloomberg", "cnbc", "wsj"]
FORUM_RELEASE = r"(?i)\b(Show HN|Launch HN|repo|release|v[\d\.]+|github\.com)\b"
OPINION = r"(?i)\b(Study|opinion|what i learned|marx|keynes|history|why |deleted her emails)\b"
ECHOED = ["엔지니어가 이 글을 지금 당장 읽어야 하는", "1줄 결정적 훅", "Compelling 1-line hook for engineers", "直击工程师痛点的1句话亮点"]
TIER_WEIGHTS = {"tier_1_ground_truth": 1.0, "tier_2_verified_secondary": 0.8, "tier_3_community_informational": 0.5, "tier_4_unverified_noise": 0.1}


def whole_words(words: list[str]) -> str:
    """A pattern for any of the words with no letter, digit or underscore beside it; for Java and RE2 alike."""
    quoted = "|".join(w.replace("-", r"\-") for w in words)
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{quoted})(?:$|[^\p{{L}}\p{{N}}_])"


def enrich_category(text: Column, platform: Column, item_type: Column) -> Column:
    """By whole words of lower-case text; a platform of models, or the type MODEL, makes a foundation model of what is left."""
    rules = []
    for name, words, pairs in ENRICH_WORDS:
        hit = text.rlike(whole_words(words))
        for a, b in pairs:
            hit = hit | (text.rlike(whole_words(a)) & text.rlike(whole_words(b)))
        if name == "FOUNDATION_MODELS":
            hit = hit | platform.contains("models") | platform.contains("hub") | (item_type == "MODEL")
        rules.append((hit, name))
    return first_match(rules, "INDUSTRY_TRENDS")


def words_category(text: Column, rules: list[tuple[str, list[str]]], more: dict[str, list[str]] | None = None) -> Column:
    """The first category one of whose words stands anywhere in lower-case text."""
    return first_match([(any_of(text, words + (more or {}).get(name, [])), name) for name, words in rules], "INDUSTRY_TRENDS")


def words_item_type(text: Column, category: Column) -> Column:
    rules = [(category == c, t) for c, t in REPEAT_TYPES.items()]
    return first_match([((category == "AGENTS_DEVTOOLS") & text.contains("agent"), "AGENT"), (category == "AGENTS_DEVTOOLS", "TECH"), *rules], None)


def bulk_item_type(text: Column, platform: Column) -> Column:
    model = platform.contains("model") | platform.contains("huggingface") | any_of(text, ["weights", "checkpoint", "gguf"])
    return first_match([(model, "MODEL"), (any_of(text, ["agent", "autonomous"]), "AGENT"), (any_of(platform, BULK_PRESS), "NEWS")], "TECH")


def bulk_artifact_type(text: Column, platform: Column, item_type: Column) -> Column:
    code = platform.contains("github") | any_of(text, ["repo", "github.com", "repository"])
    return first_match([(item_type == "MODEL", "WEIGHTS"), (code, "CODE_REPO"), (platform.contains("arxiv") | text.contains("paper"), "PAPER")], "ARTICLE")


def enrich_artifact_type(title: Column, platform: Column, url: Column) -> Column:
    service = platform.contains("spaces") | url.contains("spaces") | any_of(title, ["space:", "gradio"])
    agent = any_of(title, ["agent", "harness", "cli", "sdk", "browser-use", "framework"]) | platform.contains("agent")
    tuned = any_of(title, ["lora", "adapter", "finetune", "fine-tuned", "fine-tuning"])
    return first_match([(service, "WEB_SERVICE"), (agent, "SKILL_AGENT"), (tuned, "FINETUNE"), (platform.contains("models") | title.contains("weights"), "WEIGHTS")], "ARTICLE")


def known_entity(text: Column) -> Column:
    """The first of the known names that the lower-case text holds, without its space; null if none."""
    return first_match([(text.contains(n), n.replace(" ", "")) for n in KNOWN_ENTITIES], None)


def news_or_tech(title: Column, platform: Column) -> Column:
    """Forum posts that announce no release, and opinions, are news."""
    forum = platform.isin("Hacker News", "Reddit r/LocalLLaMA") & ~title.rlike(FORUM_RELEASE)
    return first_match([(forum | title.rlike(OPINION), "NEWS")], "TECH")


def valid_translation(title_ko: Column, hook_ko: Column, title_zh: Column) -> Column:
    """Hangul in the Korean title and hook, Han characters in the Chinese title."""
    return F.coalesce(title_ko.rlike("[가-힣]") & hook_ko.rlike("[가-힣]") & title_zh.rlike("[一-鿿]"), F.lit(False))


def echoes_prompt(hooks: list[Column]) -> Column:
    """Whether some hook is the placeholder of the prompt."""
    return reduce(lambda a, b: a | b, [any_of(F.coalesce(h, F.lit("")), ECHOED) for h in hooks])


def credibility(tier: Column) -> Column:
    return first_match([(tier == t, F.lit(w)) for t, w in TIER_WEIGHTS.items()], None)


def verdict_of(score: Column, has_tier_one: Column, contaminated: Column, refuted: Column, missing: Column) -> Column:
    """The verdict by thresholds on the mean weight of the evidence; flags come first."""
    return first_match([(missing, "UNVERIFIABLE"), (refuted, "CONFIRMED_FALSE"), (contaminated, "MISLEADING_GAMED"), ((score >= 0.85) & has_tier_one, "VERIFIED_TRUE"), (score >= 0.70, "MOSTLY_TRUE"), (score >= 0.50, "HALF_TRUE")], "UNVERIFIABLE")
