"""Operations for training-data pipelines; nothing else in tickloom imports this subpackage."""
