"""Rule tables of the domain and the columns made of them. Rules are data; the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import first_match

# Keyword patterns over lower-case text, in order.
CATEGORY_RULES = [
    ("convicted|conviction|verdict|guilty|sentence|sentenced|judge|court|legal|trial|crime|criminal|police|arrest|jail|prison|neglect|custody|lawsuit|attorney|prosecutor|판결|유죄|법원|징역|형사|방임|기소|선고", "CIVIC_CRIME_INCIDENT"),
    ("gguf|vllm|sglang|ollama|awq|fp8|int4|int8|quantization|추론|양자화|서빙|가속", "INFERENCE_OPT"),
    ("vlm|diffusion|tts|stt|whisper|flux|wan|sora|kling|video|vision|audio|speech|voice|multimodal|멀티모달|음성|비디오|영상", "MULTIMODAL_AI"),
    ("agent|agents|browser.use|crawler|scraper|devtools|copilot|sdk|cli|framework|에이전트|자동화|개발도구", "AGENTS_DEVTOOLS"),
    ("rag|vectordb|vector.database|embedding|jailbreak|cve|vulnerability|security|보안|취약점|탈옥|임베딩", "INFRA_RAG_SECURITY"),
    ("aerospace|rocket|orbit|satellite|nasa|astronomy|dark matter|우주|항공우주|인공위성|천문", "DEEP_SCIENCE_SPACE"),
    ("gold|reserve|central bank|inflation|interest rate|macroeconomics|gdp|금|중앙은행|인플레이션|기준금리|거시경제", "MACRO_GLOBAL_BIZ"),
    ("babylonian|recipe|cooking|archaeology|medieval|고대 요리|바빌로니아|고고학|역사", "HISTORY_LIFE_CULTURE"),
    ("weights|safetensors|checkpoint|lora|foundation model|qwen|deepseek|llama|mistral|gemma|파운데이션|가중치", "FOUNDATION_MODELS"),
]
TIER_OF_CATEGORY = {"CIVIC_CRIME_INCIDENT": "LAW_CRIME_JUSTICE", "DEEP_SCIENCE_SPACE": "SCIENCE_RESEARCH", "MACRO_GLOBAL_BIZ": "ECONOMY_FINANCE", "HISTORY_LIFE_CULTURE": "CULTURE_HUMANITIES"}
LAW_WORDS = "convicted|verdict|guilty|sentence|judge|court|legal|crime|police|arrest|lawsuit|prosecutor|판결|유죄|법원|형사|방임"
NEWS_WORDS = "convicted|verdict|guilty|sentence|judge|court|legal|trial|crime|criminal|police|arrest|jail|prison|shooting|attack|minister|election|antitrust|lawsuit|prosecutor|판결|유죄|법원|형사|기소"
FAMILY_RULES = [
    (r"(?i)\b(glm[\s\-]*5[\.\d]*|glm5)\b", "GLM-5.3 Multi-Modal Foundation Family"),
    (r"(?i)\b(qwen[\s\-]*3[\.\d]*[\s\-]*27b|qwen38[\s\-]*27b)\b", "Qwen-3.8-27B Dense/MoE Family"),
    (r"(?i)\b(qwen[\s\-]*3[\.\d]*[\s\-]*flash|qwen38[\s\-]*flash)\b", "Qwen-3.8-Flash-Next Family"),
    (r"(?i)\b(qwen[\s\-]*2\.5[\s\-]*coder|qwen25[\s\-]*coder)\b", "Qwen-2.5-Coder Family"),
    (r"(?i)\b(qwen[\s\-]*2\.5|qwen25)\b", "Qwen-2.5 Foundation Family"),
    (r"(?i)\b(deepseek[\s\-]*r1|deepseek[\s\-]*reasoner)\b", "DeepSeek-R1 Reasoning Family"),
    (r"(?i)\b(deepseek[\s\-]*v3|deepseek[\s\-]*v4)\b", "DeepSeek-V3/V4 MoE Family"),
    (r"(?i)\b(wan[\s\-]*2[\.\d]*)\b", "Wan-2.x Video Generation Family"),
    (r"(?i)\b(flux[\s\.]*1|flux)\b", "FLUX.1 Diffusion Family"),
    (r"(?i)\b(llama[\s\-]*3[\.\d]*)\b", "Llama-3.x Foundation Family"),
    (r"(?i)\b(whisper|kokoro|breeze[\s\-]*tts)\b", "Audio/TTS Foundation Family"),
    (r"(?i)\b(watercrawl|firecrawl|crawl4ai|anydoc)\b", "Web/Doc Ingestion Engine Family"),
    (r"(?i)\b(praxist|swe[\s\-]*agent|claude[\s\-]*code)\b", "Autonomous Agent Harness Family"),
    (r"(?i)\b(sglang|vllm|tensorrt)\b", "High-Throughput Serving Engine Family"),
]
NO_FAMILY = "기타 독립 모델 (Standalone / Novel)"
ROLE_RULES = [
    (r"(?i)\b(demo|space|gradio|hf space)\b", "🚀 인터랙티브 웹 데모 (Web Space Demo)", "Interactive Web Demo"),
    (r"(?i)\b(abliterated|obliterated|uncensored|jailbreak|mtp)\b", "🔓 검열해제 / 어블리터레이션 (Abliterated Fine-tune)", "Fine-tune / Uncensored"),
    (r"(?i)\b(dynamic gguf|unsloth.*gguf)\b", "⚡ Unsloth 선택적 동적 양자화 (Dynamic GGUF)", "Dynamic GGUF v3.0"),
    (r"(?i)\b(gguf|q4_k_m|q8_0|ud[\-_]\d+)\b", "💾 표준 GGUF 양자화본 (llama.cpp/vLLM)", "GGUF"),
    (r"(?i)\b(mlx)\b", "🍎 Apple Silicon MLX 네이티브 최적화본", "Apple MLX"),
    (r"(?i)\b(fp8|nvfp4|awq|gptq|exl2)\b", "⚡ GPU 전용 고속 양자화 (FP8/AWQ)", "FP8/AWQ"),
    (r"(?i)\b(base|instruct|official|safetensors)\b", "👑 기저 공식 원본 모델 (Base Official Model)", "Safetensors (FP16/BF16)"),
]
BASE_ROLE, STANDARD_ROLE = ROLE_RULES[-1][1], "일반 파생/배포본 (Standard Release)"
FORMAT_WORDS, DEFAULT_FORMAT = [("gguf", "GGUF"), ("fp8", "FP8"), ("mlx", "MLX")], "기본 가중치 (Default Weight)"
CREATOR = r"(?i)\b(zai[\-_]org|unsloth|qwen|deepseek[\-_]ai|black[\-_]forest[\-_]labs|orcarouter|huihui[\-_]ai|jonathancoletti|hauhaucs|obliteratus|meta|mistralai|google)\b"
CREATORS = {"zai-org": "Zhipu AI (GLM Org)", "unsloth": "Unsloth AI", "qwen": "Qwen Alibaba", "deepseek-ai": "DeepSeek AI", "orcarouter": "OrcaRouter Community", "huihui-ai": "Huihui AI", "jonathancoletti": "Jonathan Coletti", "hauhaucs": "HauhauCS", "obliteratus": "OBLITERATUS Project", "meta": "Meta AI", "mistralai": "Mistral AI", "google": "Google DeepMind"}
RELEVANT = r"\b(ai|llm|gpt|claude|gemini|deepseek|qwen|kimi|glm|hunyuan|stepfun|llama|mistral|openai|anthropic|deepmind|nvidia|gpu|tpu|npu|transformer|diffusion|agent|agentic|mcp|rag|vector|embedding|quantum|robot|robotics|autonomous|chip|semiconductor|cyber|security|vulnerability|cve|zero-day|hack|malware|encryption|neural|brain|protein|alphafold|crispr|genome|fusion|algorithm|compute|datacenter|cloud|kubernetes|rust|python|compiler|open-source|benchmark|reasoning|multimodal|vision|speech|tts|asr|fine-tun|rlhf|quantiz|inference)\b"
RELEVANT_WORDS = "인공지능|생성형|모델|반도체|양자|로봇|보안|취약점|해킹|알고리즘|클라우드|오픈소스|데이터센터|신경망|딥러닝|머신러닝|에이전트|大模型|人工智能|算力|芯片|开源|智能体|算法|量子|机器人|深度求索|通义|千问|混元|智谱|月之暗面|阶跃|多模态|微调|推理"
MODEL_SOURCES, NEWS_SOURCES = ["Hugging", "Space", "Model"], ["News", "Hacker", "Blog", "GitHub", "Twitter", "X"]
ROOT_PAGES = ["https://news.ycombinator.com", "https://github.com", "https://huggingface.co"]
ENTITY_PATTERN = r"\b(qwen[-_ ]?image[-_ ]?2\.?1|qwen[-_ ]?3\.?8[-_ ]?35b|qwen[-_ ]?2\.?5[-_ ]?coder|deepseek[-_ ]?[rv]\d+[\w.-]*|llama[-_ ]?\d+[\w.-]*|glm[-_ ]?\d+[\w.-]*|flux[-_ ]?\d+[\w.-]*|jev)\b"
STORY_SUFFIX = r"-(?:github|huggingface|geeknews|hn|demo|release|repo|compact|efficient|unified|uncensored|gguf|trending).*$"


def category(text: Column, platform: Column) -> Column:
    rules = [(text.rlike(p), name) for p, name in CATEGORY_RULES]
    return first_match([*rules, (platform.contains("models"), "FOUNDATION_MODELS")], "INDUSTRY_TRENDS")


def tier_one(text: Column, primary: Column) -> Column:
    law = (primary == "CIVIC_CRIME_INCIDENT") | text.rlike(LAW_WORDS)
    return first_match([(law, "LAW_CRIME_JUSTICE"), *[(primary == c, t) for c, t in TIER_OF_CATEGORY.items()]], "TECH_COMPUTING")


def artifact_type(text: Column, platform: Column) -> Column:
    return first_match([(platform.contains("spaces") | text.rlike("spaces|gradio"), "WEB_SERVICE"), (text.rlike("agent|harness|cli|sdk|framework|devtools") | platform.contains("github"), "SKILL_AGENT"), (text.rlike("lora|adapter|finetune|fine-tuning"), "FINETUNE"), (text.rlike("gguf|safetensors|fp8|weights") | platform.contains("models"), "WEIGHTS")], "ARTICLE")


def item_type(text: Column, platform: Column, primary: Column, tier: Column, artifact: Column) -> Column:
    news = tier.isin("LAW_CRIME_JUSTICE", "POLITICS_POLICY") | (primary == "CIVIC_CRIME_INCIDENT") | text.rlike(NEWS_WORDS)
    model = (artifact == "WEIGHTS") | text.rlike("gguf|lora|safetensors|checkpoint|weights|7b|14b|70b|32b") | platform.contains("models")
    agent = (artifact == "SKILL_AGENT") | text.rlike("agent|crawler|scraper|devtools|copilot")
    return first_match([(news, "NEWS"), (model, "MODEL"), (agent, "AGENT")], "TECH")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "[_/:]", " ")


def model_family(text: Column) -> Column:
    return first_match([(_plain(text).rlike(p), name) for p, name in FAMILY_RULES], NO_FAMILY)


def _roles(text: Column) -> list[tuple[Column, str, str]]:
    plain = _plain(text)
    return [(plain.rlike(p) if role != BASE_ROLE else plain.rlike(p) & ~plain.rlike("(?i)gguf|awq|mlx"), role, fmt) for p, role, fmt in ROLE_RULES]


def variant_role(text: Column) -> Column:
    return first_match([(hit, role) for hit, role, _ in _roles(text)], STANDARD_ROLE)


def detected_format(text: Column) -> Column:
    """The format that goes with the role, else the first format word in the text."""
    low = F.lower(_plain(text))
    return first_match([(hit, fmt) for hit, _, fmt in _roles(text)] + [(low.contains(w), fmt) for w, fmt in FORMAT_WORDS], DEFAULT_FORMAT)


def creator(text: Column) -> Column:
    """Who made it, by the first known name in the text; other known names as they are with a capital."""
    found = F.lower(F.regexp_extract(_plain(text), CREATOR, 1))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in CREATORS.items() for x in kv]), found)
    return F.when(found == "", "Community").otherwise(F.coalesce(named, F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 100))))


def valid_candidate(url: Column) -> Column:
    """Starts with http, no bare root page, an id where a forum item is named, owner and repository where code is."""
    u = F.trim(F.coalesce(url, F.lit("")))
    forum = ~u.contains("news.ycombinator.com/item?id=") | u.rlike(r"item\?id=\d+")
    code = ~u.contains("github.com") | u.rlike(r"github\.com/[\w\.-]+/[\w\.-]+")
    return u.startswith("http") & ~F.regexp_replace(u, "/+$", "").isin(ROOT_PAGES) & forum & code


def story_entity(text: Column, story_key: Column) -> Column:
    """A versioned name in the text, else the story key without its suffix, else ''."""
    named = F.regexp_replace(F.regexp_extract(F.lower(text), ENTITY_PATTERN, 1), "[-_ ]+", "-")
    cut = F.regexp_replace(F.lower(story_key), STORY_SUFFIX, "")
    return F.when(named != "", named).when((F.length(story_key) > 5) & (F.length(cut) >= 4), cut).otherwise("")


def canonical_platform(platform: Column, url: Column) -> Column:
    p, u = F.lower(F.coalesce(platform, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    rules = [(p.contains("github") | u.contains("github.com"), "github"), (p.contains("space") | u.contains("/spaces/"), "hf_spaces"), (p.contains("hugging") | u.contains("huggingface.co"), "huggingface"), (p.contains("hacker news") | u.contains("ycombinator.com"), "hackernews"), (p.contains("geeknews") | u.contains("hada.io"), "geeknews"), (p.contains("reddit") | u.contains("reddit.com"), "reddit"), (p.contains("arxiv") | u.contains("arxiv.org"), "arxiv")]
    return F.coalesce(first_match(rules, None), F.nullif(p, F.lit("")), u)


def run_slot(local: Column, name: Column) -> Column:
    """Label of the scheduled run that a local start time belongs to."""
    h = F.hour(local)
    late = name.contains("Daily 23:30") | ((h == 23) & (F.minute(local) >= 25))
    return first_match([(late, "23:30"), (h < 6, "00:17"), (h < 12, "06:17"), (h < 18, "12:17")], "18:17")


def relevant(text: Column) -> Column:
    """The keyword gate of broad feeds, in three languages."""
    return text.rlike("(?i)" + RELEVANT) | text.rlike(RELEVANT_WORDS)


def recent_or_undated(ts: Column, as_of: Column, days: int = 14) -> Column:
    """Within the window; what has no date passes."""
    return ts.isNull() | (ts >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def is_news(enriched: Column, kind: Column, category: Column, platform: Column) -> Column:
    named = F.lit(False)
    for w in NEWS_SOURCES:
        named = named | platform.contains(w)
    return F.coalesce(enriched & (F.coalesce(kind == "NEWS", F.lit(False)) | F.coalesce(category == "NEWS", F.lit(False)) | F.coalesce(named, F.lit(False))), F.lit(False))


def is_model(enriched: Column, kind: Column, category: Column, platform: Column, family: Column, source_platforms: Column) -> Column:
    """A model by its classification, category, platform, some source, or family; a family alone doesn't count on code platforms."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    some_source = F.exists(source_platforms, lambda p: sure(p.contains(MODEL_SOURCES[0]) | p.contains(MODEL_SOURCES[1]) | p.contains(MODEL_SOURCES[2])))
    place = sure(platform.contains("Models") | platform.contains("Spaces") | (platform.contains("Hugging") & platform.contains("Hub")))
    named = sure((family != "") & ~family.rlike("General|독립|Harness|Standalone")) & ~sure(platform.contains("GitHub"))
    return enriched & (sure(kind == "MODEL") | sure(category.isin("FOUNDATION_MODELS", "model")) | place | sure(some_source) | named)
