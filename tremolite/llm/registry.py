"""The corpus queries and, where SQL can express them, their SQL twins."""

from . import chat, cnn_quality, collocations, decontaminate, embedding_dedup, mixing, pii, sentence_pieces, simhash, spelling, substring_dedup, url_filter, warc

_MODULES = (warc, simhash, pii, embedding_dedup, decontaminate, mixing, cnn_quality, url_filter, substring_dedup, chat, spelling, sentence_pieces, collocations)
QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE}
