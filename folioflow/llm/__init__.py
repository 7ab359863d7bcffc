"""Training-data operators: fingerprints, mixing, sanitising, extraction, search, language and toxicity
labels, shingle joins, fixity audits and tokenisation. Nothing outside this subpackage imports it."""
