"""Column-level functions: text, language, PII, licences."""
