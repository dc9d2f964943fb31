"""notelens.streaming"""
