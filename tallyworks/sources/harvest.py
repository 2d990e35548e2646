"""Rows of public listings as candidates: models, repositories, forum stories, entries that link elsewhere. Projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import any_of, first_match

# Families of models by a part of their id, in order, and the formats that tags name.
MODEL_FAMILIES = [
    (["qwen"], "Qwen"), (["deepseek"], "DeepSeek"), (["minimax"], "MiniMax"), (["wan"], "Wan"), (["flux"], "FLUX"), (["llama"], "Llama"), (["glm"], "GLM"), (["hunyuan"], "Hunyuan"), (["whisper", "tts", "speech", "audio", "voice", "firered"], "Audio / Speech"), (["mistral", "codestral"], "Mistral"), (["gemma"], "Gemma"),
]
FORMAT_TAGS = {"safetensors": "Safetensors", "gguf": "GGUF", "fp8": "FP8", "8-bit": "8-bit", "mlx": "MLX", "diffusers": "Diffusers", "transformers": "Transformers"}
NAMED_FORMATS = [("gguf", "GGUF"), ("fp8", "FP8"), ("lora", "LoRA")]
MODEL = "id string, trendingScore double, downloads long, likes long, pipeline_tag string, tags array<string>, library_name string, createdAt string, lastModified string"
REPOSITORY = "full_name string, html_url string, description string, stargazers_count long, forks_count long, created_at string"


def parameter_size(model_id: Column) -> Column:
    """27B, 7B, 350M: the first number with a unit in the id, else N/A."""
    found = F.regexp_extract(model_id, r"\b(\d+(?:\.\d+)?[BMb])\b", 1)
    return F.when(found == "", "N/A").otherwise(F.upper(found))


def family(model_id: Column) -> Column:
    low = F.lower(model_id)
    return first_match([(any_of(low, words), name) for words, name in MODEL_FAMILIES], "Standalone")


def formats(model_id: Column, tags: Column) -> Column:
    """Formats that the tags name, then those in the id that aren't there yet; Safetensors if none."""
    low, named = F.lower(model_id), F.create_map(*[F.lit(x) for kv in FORMAT_TAGS.items() for x in kv])
    tagged = F.array_compact(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.element_at(named, F.lower(t))))
    for word, name in NAMED_FORMATS:
        tagged = F.when(low.contains(word) & ~F.array_contains(tagged, name), F.array_append(tagged, name)).otherwise(tagged)
    return F.when(F.size(tagged) == 0, F.array(F.lit("Safetensors"))).otherwise(tagged)


def models(raw: DataFrame) -> DataFrame:
    """Candidates of a listing of models (columns of MODEL); rows without id are left out."""
    score, tag = F.round(F.coalesce("trendingScore", F.lit(0.0)), 1), F.coalesce(F.nullif("pipeline_tag", F.lit("")), F.lit("text-generation"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return raw.where(F.coalesce("id", F.lit("")) != "").select(
        F.concat(F.lit("HuggingFace Model: "), "id").alias("title"), F.lit("Hugging Face Models").alias("source_platform"), F.concat(F.lit("https://huggingface.co/"), "id").alias("source_url"), F.coalesce("createdAt", "lastModified").alias("published_at"),
        F.concat(F.lit("Trending Score: "), score, F.lit(", Downloads: "), count("downloads"), F.lit(", Likes: "), count("likes"), F.lit(", Pipeline: "), tag).alias("description"),
        F.concat(F.lit("Trending "), score, F.lit(" pts (❤️ "), count("likes"), F.lit(")")).alias("viral_metric"), tag.alias("task_modality"), family(F.col("id")).alias("model_family"), parameter_size(F.col("id")).alias("parameter_size"), formats(F.col("id"), F.col("tags")).alias("detected_formats"), F.coalesce("library_name", F.lit("")).alias("library_name"),
    )


def first_of_lists(lists: list[DataFrame], key: str, order: str) -> DataFrame:
    """Lists one after another; of a key that comes again the first row stays, by list and then by `order`. An aggregate, no window."""
    both = None
    for i, rows in enumerate(lists):
        numbered = rows.withColumn("__list", F.lit(i))
        both = numbered if both is None else both.unionByName(numbered)
    kept = both.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.min_by(F.struct(*lists[0].columns), F.struct("__list", order)).alias("row"))
    return kept.select("row.*")


def repositories(lists: list[DataFrame]) -> DataFrame:
    """Candidates of searches for repositories (columns of REPOSITORY), each repository once."""
    raw = first_of_lists(lists, "full_name", "html_url")
    stars, about = F.coalesce("stargazers_count", F.lit(0)), F.coalesce(F.nullif("description", F.lit("")), F.lit("No description"))
    return raw.select(F.concat(F.lit("GitHub: "), "full_name").alias("title"), F.lit("GitHub Official").alias("source_platform"), F.col("html_url").alias("source_url"), F.col("created_at").alias("published_at"), F.concat(F.lit("Stars: "), stars, F.lit(", Forks: "), F.coalesce("forks_count", F.lit(0)), F.lit(" | "), about).alias("description"), F.concat(F.lit("★ "), stars, F.lit(" Stars")).alias("viral_metric"))


def external_link(html: Column, otherwise: Column) -> Column:
    """The first absolute link of a piece of HTML, else the entry's own."""
    return F.coalesce(F.nullif(F.regexp_extract(html, r"""href=['"](https?://[^'"]+)['"]""", 1), F.lit("")), otherwise)


def abstract(html: Column, n: int = 200) -> Column:
    """The first n characters of the text without tags."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")), 1, n)
