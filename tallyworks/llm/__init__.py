"""Operations of a training-data pipeline: tokens, dedup, quality, secrets, personal data, shards."""
