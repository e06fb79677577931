"""Analytics on language-model output and lexical sense, as PySpark DataFrame operators."""
