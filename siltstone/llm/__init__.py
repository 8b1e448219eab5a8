"""Operations of a training-data pipeline: sharding, extraction, token files,
deduplication, search, mixing, decontamination and quality classification.

Nothing else in the library imports this subpackage."""
