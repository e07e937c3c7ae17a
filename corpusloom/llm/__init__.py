"""Operations that prepare text at scale for language-model training."""
