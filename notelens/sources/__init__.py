"""notelens.sources"""
