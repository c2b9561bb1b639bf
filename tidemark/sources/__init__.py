"""Readers and writers: chat files and streams, samples, logs, documents, exports, retention."""
