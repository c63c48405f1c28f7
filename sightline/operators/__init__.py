"""sightline.operators"""
