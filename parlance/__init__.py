"""Conversation and knowledge-base analytics as lazy Spark plans."""
