"""Readers and writers: message files, mailboxes, logs, and a stream of numbered changes."""
