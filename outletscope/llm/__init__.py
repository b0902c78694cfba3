"""Operations of a training-data pipeline on corpora of documents."""
