"""Query trees, the JSON query language, and their translation to DataFrame plans."""
