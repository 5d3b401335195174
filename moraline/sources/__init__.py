"""Sources and sinks: vocabularies, sentences, generated corpora, tables, clicks."""
