"""Operations of a training-data pipeline: dedup, mixing, filtering, extraction, encoding, sharding.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
