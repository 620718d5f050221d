"""Readers and writers of texts, embeddings, rules, configurations and snapshots."""
