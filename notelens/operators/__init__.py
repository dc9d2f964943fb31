"""notelens.operators"""
