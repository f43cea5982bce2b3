"""Readers of chat-log formats; each turns lines or documents into canonical messages."""
