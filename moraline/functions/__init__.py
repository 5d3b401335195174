"""Scalar text functions: Hangul syllables, kana, romaji and words."""
