"""Operations of a training-data pipeline: filters, scans, near duplicates, mixing."""
