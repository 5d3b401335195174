"""Stateful operators over streams of keystrokes, words, selections and clicks."""
