"""notelens.plans"""
